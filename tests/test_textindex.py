"""The persisted full-text index: equal to a scan, whole after changes, and reading little."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from foliomill.functions import text as X
from foliomill.operators.textindex import TextIndex

WORDS = ["river", "stone", "license", "mit", "wolf", "moon", "ash", "élan", "über", "x9"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, range(10, 0, -1), k=rng.choice([1, 3, 8, 40, 200])))) for i in range(600)]
    rows += [(900, None), (901, ""), (902, "MIT\n\tLicense, permit license"), (903, "the wolves running; a wolf ran")]
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return TextIndex(spark, str(tmp_path_factory.mktemp("index"))).create(docs, buckets=8, block_docs=100)


def rows(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


REQUESTS = ["license", "mit license", '"MIT License"', "wolf AND moon", "über OR x9", "élan", "wolf moon ash", "nothing", "wolf AND nothing", "wolf wolf"]


@pytest.mark.parametrize("request_", REQUESTS)
def test_index_equals_scan(index, docs, request_):
    filled = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for limit, offset in ((5, 0), (20, 3), (10_000, 0)):
        assert rows(index.search(request_, limit, offset)) == rows(X.bm25(filled, "id", "text", request_, limit, offset))
    assert index.count(request_) == X.bm25(filled, "id", "text", request_, 10_000).count()


def test_best_matches_read_some_blocks(index):
    _, state, _, some = index.plan("license", 3)
    _, _, _, whole = index.plan("license", None)
    assert set(some) < set(whole)
    assert len(some) <= len(whole) / 2
    # a conjunction leaves out blocks that lack a word
    assert set(index.plan("wolf AND x9", None)[3]) <= set(index.plan("wolf", None)[3])


def test_only_postings_of_the_words_are_read(index):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        index.postings(["license", "mit"], [1, 2]).explain("formatted")
    plan = out.getvalue()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term, [license,mit])" in plan and "texts-" not in plan and "BatchScan" not in plan


def test_snippets_rank_and_total(index):
    found = {r["id"]: r for r in index.find("mit license", 1000).collect()}
    assert found[902]["snippet"] == "<mark>MIT\n\tLicense</mark>, permit license"
    assert (found[902]["char_offset"], found[902]["char_end"]) == (0, 12)
    assert {r["total"] for r in found.values()} == {len(found)} == {index.count("mit license")}
    assert sorted(r["rank"] for r in found.values()) == list(range(1, len(found) + 1))
    page = index.find("mit license", 2, 1).collect()
    assert sorted(r["rank"] for r in page) == [2, 3] and {r["total"] for r in page} == {len(found)}


def test_characters_where_no_word_matches(index):
    hits = index.find("ermit licen", 10).collect()
    assert [(r["id"], r["score"], r["total"], r["snippet"]) for r in hits] == [(902, 0.0, 1, "MIT\n\tLicense, p<mark>ermit licen</mark>se")]
    assert index.find("%", 10).collect() == [] and index.find('""', 10).collect() == []


def test_changes_leave_no_old_postings(spark, docs, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i")).create(docs, buckets=4, block_docs=100)
    changed = spark.createDataFrame([(1, "granite only"), (2, None), (902, "mit"), (5000, "granite license"), (5001, "wolf granite")], "id long, text string")
    index.upsert(changed)
    index.delete(spark.createDataFrame([(3,), (5001,), (77_777,), (None,)], "id long"))
    index.upsert(spark.createDataFrame([(1, "granite moon"), (3, "moon again")], "id long, text string"))
    now = {r["id"]: r["text"] or "" for r in docs.collect()} | {1: "granite moon", 2: "", 902: "mit", 5000: "granite license", 3: "moon again"}
    held = spark.createDataFrame(sorted(now.items()), "id long, text string")

    def same():
        assert {r["id"]: r["text"] for r in index.texts().collect()} == now
        for q in ("granite", "license", "mit license", "wolf AND moon", "moon OR river", "only"):
            assert rows(index.search(q, 50)) == rows(X.bm25(held, "id", "text", q, 50)), q
            assert index.count(q) == X.bm25(held, "id", "text", q, 10_000).count()

    same()
    assert index.postings(["only"]).count() == 0
    before = index.versions.read()
    index.compact()
    assert len(before["segments"]) == 4 and len(index.versions.read()["segments"]) == 1
    same()
    gone = index.versions.sweep()
    assert gone and not set(gone) & set(index.versions.read()["segments"][0].values())
    same()


def test_states_are_whole(spark, docs, tmp_path):
    """A writer that stops leaves the old state; two that start from one state cannot both follow it."""
    path = str(tmp_path / "i")
    index = TextIndex(spark, path).create(docs.limit(50), buckets=2)
    was = rows(index.search("license", 50))
    state = index.versions.read()
    index._segment(state, index._texts(spark.createDataFrame([(1, "license " * 9)], "id long, text string"), "id", "text"), None)
    assert rows(TextIndex(spark, path).search("license", 50)) == was
    index.versions.commit(state)
    with pytest.raises(RuntimeError):
        index.versions.commit(state)


def test_stems_and_bad_ids(spark, docs, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i")).create(docs, stemmed=True, buckets=2)
    assert {r["id"] for r in index.search("licenses", 1000).collect()} >= {902}
    hit = [r for r in index.find("running", 1000).collect() if r["id"] == 903]
    assert hit and "<mark>running</mark>" in hit[0]["snippet"]
    twice = docs.unionByName(docs)
    with pytest.raises(ValueError):
        index.upsert(twice)
    with pytest.raises(ValueError):
        TextIndex(spark, str(tmp_path / "none")).search("x")


def test_an_empty_index(spark, docs, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i")).create(docs.limit(0))
    assert index.search("license").collect() == [] and index.count("license") == 0 and index.find("license").collect() == []
    index.upsert(docs.limit(10))
    index.delete(index.texts().select("id"))
    assert index.search("license").collect() == []


def test_library_searches_its_index(library, tmp_path):
    from foliomill.library import Library

    lib = Library(library)
    with pytest.raises(ValueError):
        lib.run("search_fulltext", "find", query="comment")
    assert lib.run("search_fulltext", "build_index", path=str(tmp_path / "i")).count() == 4
    assert [r["id"] for r in lib.run("search_fulltext", "find", query="comment", limit=2).collect()] == [1, 2]
    lib.run("search_fulltext", "update_index", changed=library["comments"].limit(1).withColumn("text", F.lit("a lighthouse")))
    hit = lib.run("search_fulltext", "find", query="lighthouse", enrich=True).collect()
    assert [(r["id"], r["title"], r["total"]) for r in hit] == [(1, "A Study in Scarlet", 1)]


def test_questions_go_to_the_index_first(library, tmp_path):
    from datetime import date

    from foliomill.functions import nlquery
    from foliomill.library import Library

    texts = library["comments"].withColumn("text", F.when(F.col("book") == 3, "a lighthouse keeper and lonely love").otherwise(F.col("text")))
    lib = Library(library | {"comments": texts})
    lib.run("search_fulltext", "build_index", path=str(tmp_path / "i"))
    ask = lambda q: [(r["id"], r["fallback"]) for r in lib.run("query_books", "ask", query=q, now=date(2024, 5, 1)).collect()]
    question = "what books do we have about a lonely lighthouse keeper"
    assert nlquery.parse(question, date(2024, 5, 1)).prefer_semantic_search
    assert ask(question) == [(3, False)]
    assert all(back for _, back in ask("what books do we have about zeppelins"))
