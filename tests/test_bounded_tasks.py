"""Tasks whose rows or texts do not grow with the table."""

import math
import zlib

import pyarrow as pa
import pytest

from foliomill.functions import chunking
from foliomill.functions import text as X
from foliomill.operators import sync, textindex, vectors


@pytest.mark.parametrize("policy", sync.POLICIES)
def test_versions_are_dealt_by_their_number(spark, monkeypatch, policy):
    make = lambda rows: spark.createDataFrame(rows, "id long, a string, n int")
    base = [(i, f"v{i}", i) for i in range(60)] + [(None, "null", 0)]
    local = [(i, "L" if i is not None and i % 3 == 0 else a, n) for i, a, n in base if i is None or i % 7] + [(1000, "new", 1)]
    remote = [(i, "R" if i is not None and i % 2 == 0 else a, None if i == 5 else n) for i, a, n in base if i is None or i % 11] + [(1000, "other", 2)]
    tables = [make(x) for x in (base, local, remote)]
    rows = lambda: sorted(map(str, sync.merged(*tables, ["id"], ["a", "n"], policy).collect()))
    before = rows()
    monkeypatch.setattr(sync, "TASK_ROWS", 10)
    assert sync.versions(*tables, ["id"], ["a", "n"]).rdd.getNumPartitions() >= 17
    assert rows() == before


def test_chunks_of_a_batch_are_made_in_pieces():
    texts = [None, "", "  "] + [f"One {i}. Two? " * (i * 40) for i in range(1, 90)]
    for split in (chunking.boundary_split, chunking.chapter_split):
        assert chunking.in_pieces(pa.array(texts), split).to_pylist() == [split(t) for t in texts]
        assert chunking.in_pieces(pa.array([], pa.string()), split).to_pylist() == []


def test_places_are_grouped_in_slices(monkeypatch):
    texts = {7: ["b", "a", "b"], 3: [], 5: ["ü", "a"], 9: ["c"] * 9}
    batch = pa.RecordBatch.from_pydict({"id": [*texts], "n": pa.array([len(w) for w in texts.values()], pa.int32()), "block": pa.array([1, 0, 0, 2], pa.int32()), "words": pa.array([*texts.values()], pa.list_(pa.string()))})
    wanted = sorted((zlib.crc32(w.encode()) % 4, w, {7: 1, 3: 0, 5: 0, 9: 2}[i], i, len(ws), ws.count(w), [p for p, x in enumerate(ws) if x == w]) for i, ws in texts.items() for w in set(ws))
    for words in (1, 4, 100):
        monkeypatch.setattr(textindex, "SLICE_WORDS", words)
        slices = [[tuple(r.values()) for r in b.to_pylist()] for b in textindex.places(4)([batch.slice(0, 0), batch])]
        assert sorted(r for s in slices for r in s) == wanted and all(s == sorted(s) for s in slices)
        assert words == 100 or len(slices) > 1


def test_postings_are_made_by_bounded_tasks(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 50}" for j in range(20))) for i in range(300)], "id long, text string")
    monkeypatch.setattr(textindex, "TASK_WORDS", 300)
    index = textindex.TextIndex(spark, str(tmp_path / "i")).create(docs, buckets=1, block_docs=100)
    name = index.versions.read()["segments"][0]["postings"]
    files = list((tmp_path / "i" / name).glob("bucket=0/*.parquet"))
    assert len(files) >= 15
    assert index.postings(["w0"]).count() == docs.filter("array_contains(split(text, ' '), 'w0')").count()


def test_preferences_exchange_only_texts_that_hold_them(spark):
    words = [f"w{i}x{i * i % 97}" for i in range(400)]
    rows = [(i, " ".join(words[(i * 7 + j * (1 + i % 5)) % 400] for j in range(300)) + (" wanted" if i % 400 == 0 else "")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "id long, t string").repartition(4)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    docs = docs.localCheckpoint()
    before = written()
    assert {r.id for r in vectors.recommend_for(docs, "id", "t", "wanted", 9).collect()} == {0, 400, 800, 1200, 1600}
    assert written() - before < 500_000


def test_rows_of_one_id_are_one_text(spark):
    rows = [(1, "alpha beta wanted"), (1, "alpha gamma"), (2, "wanted gamma"), (3, None), (4, ""), (None, "wanted alpha"), (None, "beta"), (5, "delta delta")]
    docs = spark.createDataFrame(rows, "id long, t string")
    texts = {i: " ".join(t or "" for j, t in rows if j == i).split() for i in {i for i, _ in rows}}
    df = lambda w, ids: sum(w in texts[i] for i in ids)
    idf = lambda w, ids: math.log((1 + len(rows)) / (1 + df(w, ids))) + 1
    weights = {}
    for i in texts.keys() - {None}:
        raw = {w: texts[i].count(w) * idf(w, texts) for w in set(texts[i])}
        weights |= {(i, w): x / math.sqrt(sum(y * y for y in raw.values())) for w, x in raw.items()}
    assert {(r.id, r.term): r.weight for r in vectors.tfidf(docs, "id", "t").collect()} == pytest.approx(weights)
    named = texts.keys() - {None}
    q = {"wanted": idf("wanted", named), "gamma": 2 * idf("gamma", named)}
    unit = {w: x / math.sqrt(sum(y * y for y in q.values())) for w, x in q.items()}
    want = {i: sum(weights.get((i, w), 0) * x for w, x in unit.items()) for i in (1, 2)}
    assert {r.id: r.score for r in vectors.recommend_for(docs, "id", "t", "gamma wanted gamma", 9).collect()} == pytest.approx(want)
    assert vectors.recommend_for(docs, "id", "t", "the", 9).collect() == []


def test_changes_of_an_index_are_made_by_bounded_tasks(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 50}" for j in range(20))) for i in range(300)], "id long, text string")
    monkeypatch.setattr(textindex, "TASK_WORDS", 300)
    index = textindex.TextIndex(spark, str(tmp_path / "i")).create(docs, buckets=1)
    index.upsert(docs.filter("id % 2 = 0").selectExpr("id", "concat(text, ' w0 new') as text"))
    index.delete(docs.filter("id % 7 = 0"))
    name = index.versions.read()["segments"][1]["postings"]
    assert len(list((tmp_path / "i" / name).glob("bucket=0/*.parquet"))) >= 10
    held = docs.filter("id % 7 <> 0").selectExpr("id", "if(id % 2 = 0, concat(text, ' w0 new'), text) as text")
    rows = lambda df: [(r.id, round(r.score, 9)) for r in df.collect()]
    for q in ("w0", "new", "w3 OR new", "w0 new"):
        assert rows(index.search(q, 400)) == rows(X.bm25(held, "id", "text", q, 400))
