"""Scalar, text, chunking and request functions against plain Python."""

import random
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomill.functions import chunking, nlquery
from foliomill.functions import scalars as S
from foliomill.functions import text as X
from foliomill.operators import dedupe, mutations, sequence, vectors


def one(spark, make, *values):
    schema = ", ".join(f"c{i} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double'}" for i, v in enumerate(values))
    return spark.createDataFrame([values], schema).select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(("f", "value", "expected"), [
    (S.strip_html, "<p>a &lt;b&gt;</p>  c&amp;d", "a c&d"), (S.escape_html, "<a & 'b'>", "&lt;a &amp; &#39;b&#39;&gt;"), (S.title_case, "the LORD of the rings", "The Lord of the Rings"), (S.title_case, "of", "Of"),
    (S.tag_name, " sci-fi o'neil ", "Sci-Fi O'Neil"), (S.tag_words, "sci-fi  STORY", "Sci-fi Story"), (S.invert_author, "Doyle, Arthur Conan", "Arthur Conan Doyle"), (S.invert_author, "Plato", "Plato"),
    (S.isbn10_to_13, "0306406152", "9780306406157"), (S.isbn10_to_13, "x", "x"), (S.valid_isbn, "080442957X", True), (S.valid_isbn, "0306406153", False), (S.valid_isbn, "9780306406157", True), (S.valid_isbn, None, False),
    (S.human_size, 1536.0, "1.50 KB"), (S.human_size, 0.0, "0.00 B"), (S.parse_date, "1999-05", date(1999, 5, 1)), (S.parse_date, "2001-02-03T10:00", date(2001, 2, 3)), (S.parse_date, "44 BC", None), (S.preview, "ab", "ab"),
    (S.plain, "a*b-c'd é", "ab-c'd"), (S.blank_to_null, "  ", None), (S.file_name, 'a<b>:  "c"', "ab c"), (S.normalize_unicode, "ﬁ①", "fi1"), (S.unescape_html, "&eacute;&#x41;", "éA"),
])
def test_scalars(spark, f, value, expected):
    assert one(spark, f, value) == expected


def test_list_cleaning(spark):
    assert one(spark, S.clean_list, [" a", "a", "", "b "]) == ["a", "b"]


@pytest.mark.parametrize("n", [0, 1, 1199, 1200, 1201, 1300, 1399, 1400, 1401, 2200, 2399, 3500])
def test_boundary_chunks_cover_the_text(n):
    text = " ".join(f"w{i}" for i in range(1000))[:n].strip()
    chunks = chunking.boundary_split(text)
    assert all(0 < len(c) <= 1200 for c in chunks)
    at = 0
    for c in chunks:
        found = text.find(c, max(0, at - 1200))
        assert found >= 0
        at = max(at, found + len(c))
    assert at == len(text)


def test_boundary_chunks_move_on_past_white_space():
    assert chunking.boundary_split("a" + " " * 5000 + "b")[-1].endswith("b")


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400))
def test_boundary_chunks_lose_no_word(text):
    kept = set(" ".join(chunking.boundary_split(text, 60, 10)).split())
    assert {w for w in text.split() if len(w) < 20} <= kept | {w for c in chunking.boundary_split(text, 60, 10) for w in c.split()}


def test_chapters():
    text = "\n".join(f"Chapter {i}\n" + "body. " * 20 for i in range(1, 6))
    assert len(chunking.chapter_split(text)) == 5
    assert all(len(c) <= 700 for c in chunking.chapter_split("One sentence here. " * 200, 600, 50))


NOW = date(2024, 5, 15)


@pytest.mark.parametrize(("query", "expected"), [
    ("books by John Dickson Carr", {"author": "john dickson carr", "text": ""}), ("tagged as mystery", {"tag": "mystery"}), ("published in 1987", {"pubdate": "1987"}), ("rated 4", {"rating": 4}), ("5 stars", {"rating": 5}),
    ("in series Foundation", {"series": "foundation"}), ("manga naruto", {"content_type": "manga", "text": "naruto"}), ("dune from last month", {"added_after": "2024-04-01", "added_before": "2024-04-30", "text": "dune"}),
    ('"attention is all you need"', {"text": "attention is all you need"}), ("", {"text": ""}), ("german crime thriller stories in berlin", {"prefer_semantic_search": True, "language_hints": ["german"]}),
    ("japan", {"language_hints": ["japan"], "prefer_semantic_search": False}), ("polish poetry", {"language_hints": ["polish"], "prefer_semantic_search": False}), ("swedish norwegian notes now", {"language_hints": ["swedish", "norwegian"], "prefer_semantic_search": True}),
    ("locked room", {"prefer_semantic_search": True, "text": "locked room"}), ("how many books are there", {"prefer_semantic_search": True}), ("list all the books here", {"prefer_semantic_search": True}), ("about the boy", {"prefer_semantic_search": False}), ("recommend", {"prefer_semantic_search": False}),
])
def test_requests(query, expected):
    got = nlquery.parse(query, NOW)
    assert {k: getattr(got, k) for k in expected} == expected


def test_request_columns_agree_with_the_parser(spark):
    for q in ("books by carr", "tagged as x", "published 1990", "rated 3"):
        row = spark.createDataFrame([(q,)], "c string").select(*[c.alias(k) for k, c in nlquery.slots(F.col("c")).items()]).first()
        p = nlquery.parse(q, NOW)
        assert (row.author, row.tag, row.pubdate, row.rating) == (p.author, p.tag, p.pubdate, str(p.rating) if p.rating else None)


def test_bm25_prefers_the_fuller_match(spark):
    df = spark.createDataFrame([(1, "red fox red fox"), (2, "red dog and many other words here"), (3, "fox"), (4, None)], "id int, t string")
    assert [r.id for r in X.bm25(df, "id", "t", "red").collect()] == [1, 2]
    assert [r.id for r in X.bm25(df, "id", "t", "red fox").collect()] == [1]
    assert sorted(r.id for r in X.bm25(df, "id", "t", "dog OR fox").collect()) == [1, 2, 3]
    assert X.bm25(df, "id", "t", "").count() == 0


def test_stemming_agrees(spark):
    for w in ("licenses", "parties", "running", "walked", "class", "slowly", "is", "thing"):
        assert one(spark, X.stem, w) == X.stem_word(w)


def test_snippets(spark):
    assert one(spark, lambda c: X.snippet(c, "FOX", 4), "the red fox jumps") == "...red <mark>fox</mark> jum..."
    assert one(spark, lambda c: X.snippet(c, "cat", 4), "the red fox") is None


def test_sequences(spark):
    df = spark.createDataFrame([("s", 1.0, 1), ("s", 2.0, 2), ("s", 5.0, 3), ("s", 5.0, 4), ("t", 2.5, 5)], "k string, i double, id int")
    got = {r.k: (r.missing, r.complete) for r in sequence.gaps(df, "k", "i").collect()}
    assert got["s"] == ([3, 4], False)
    assert [(r.first, r.last) for r in sequence.gap_ranges(df, "k", "i").collect()] == [(3, 4)]
    assert {r.id: r.new_index for r in sequence.bump_duplicates(df, "k", "i").filter("changed").collect()} == {4: 5.1}
    assert sorted((r.id, r.new_index) for r in sequence.renumber(df, "k", "i").collect()) == [(3, 3.0), (4, 4.0), (5, 1.0)]
    days = spark.createDataFrame([("u", date(2024, 1, d)) for d in (1, 2, 3, 7, 8)], "u string, d date")
    r = sequence.streaks(days, ["u"], "d", F.lit("2024-01-08").cast("date")).first()
    assert (r.total_days, r.current, r.longest, r.frequency) == (5, 2, 3, 0.625)


def test_mutations(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, n string, v int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 9)], "id int, n string, v int")
    merged = {r.id: (r.n, r.v) for r in mutations.upsert(old, new, ["id"]).collect()}
    assert merged == {1: ("a", 5), 2: ("b", 7), 3: ("c", 9)}
    again = mutations.upsert(mutations.upsert(old, new, ["id"]), new, ["id"])
    assert {r.id: (r.n, r.v) for r in again.collect()} == merged
    links = spark.createDataFrame([(1, 3), (1, 5), (2, 4)], "book int, tag int")
    assert sorted(map(tuple, mutations.merge_keys(links, "tag", [3, 4], 5).collect())) == [(1, 5), (2, 5)]


def test_fuzzy_groups(spark):
    df = spark.createDataFrame([(1, "science fiction", 3), (2, "science-fiction", 9), (3, "poetry", 1)], "id long, name string, books long")
    r = dedupe.fuzzy_groups(df, F.lit(0)).collect()
    assert [(x.canonical, sorted(x.members)) for x in r] == [(2, [1, 2])]


def test_similar_names_match_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(3)
    names = ["mystery", "mistery", "Fantasy", "fantasy", "scifi", "hardscifi", "sci-fi", "xfantasy", "Éa", "éa", "a", ""]
    while len(names) < 120:
        w = list(rng.choice(names[:60]) or "seed")
        w[rng.randrange(len(w))] = rng.choice(["", "e", "xy", "T"])
        if "".join(w) not in names:
            names.append("".join(w))
    df = spark.createDataFrame([(i, x, i % 5) for i, x in enumerate(names)], "id long, name string, books long").repartition(3)
    low = [x.lower() for x in names]
    like = lambda i, j: SequenceMatcher(None, low[i], low[j]).ratio()
    for least in (0.6, 0.75, 0.8):
        want = {(i, j) for i in range(len(low)) for j in range(i + 1, len(low)) if like(i, j) >= least}
        got = [(r.a, r.b) for r in dedupe.similar_pairs(df, least=least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and (2, 3) in want and (0, 1) in want
        groups = dedupe.greedy_groups(df.toPandas(), least)
        assert sorted(sorted(r.members) for r in dedupe.fuzzy_groups(df, least=least).collect()) == sorted(groups)
    best = {}
    for i, x in enumerate(low):
        for j, y in enumerate(low):
            if (len(x), x) < (len(y), y) and (x in y or like(i, j) >= 0.8):
                best[names[j]] = min(best.get(names[j], names[i]), names[i], key=lambda n: (len(n), n))
    got = {r.tag: r.canonical for r in dedupe.similar_tags(df.select("name"), 0.8).collect()}
    assert got == best
    one = spark.createDataFrame([("scifi",), ("hardscifi",), ("mystery",), ("mistery",)], "name string")
    assert {r.tag: r.canonical for r in dedupe.similar_tags(one).collect()} == {"hardscifi": "scifi", "mystery": "mistery"}


def test_documents_with_whole_passages(spark):
    from foliomill.functions import text as X

    opening = "w" * 60
    needles = {1: "fox", 2: "two words", 3: "the quick fox", 4: "wn fox jumps ov", 5: f"{opening} and the end", 6: "absent words are not there", 7: " led by space", 8: None}
    docs = {1: "foxes in two wordsmiths", 2: "the quick fox: a brown fox jumps over it", 3: f"{opening} and another end", 4: f"{opening} and the end", 5: "it is led by spaces", 6: "the end", 7: None}
    got = X.documents_with(spark.createDataFrame(list(needles.items()), "item_id long, needle string"), spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    want = {i: sum(n in t for t in docs.values() if t) if n else 0 for i, n in needles.items()}
    assert {r.item_id: r.docs for r in got.collect()} == want and want[4] == 1 and want[5] == 1


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [0.0, 0.0])], "id int, vector array<double>")
    assert [r.id for r in vectors.nearest_to_row(df, 1, 2).collect()] == [3, 4]
    assert [r.id for r in vectors.nearest(df, [0.0, 2.0], 1, metric="cosine").collect()] == [2]
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "delta")], "id int, t string")
    assert [r.id for r in vectors.recommend(vectors.tfidf(docs, "id", "t"), 1, 5).collect()] == [2]


def test_streams_equal_batches(spark, tmp_path):
    from foliomill.streaming import sessions as W

    rows = [(i, f"2024-01-01 0{i % 6}:00:00", i % 3, "view", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = W.read_events(spark, str(tmp_path / "e"))
    batch = sorted(map(tuple, df.groupBy("user_id").agg(F.sum("value").alias("t")).collect()))
    got = W.run_once(stream.groupBy("user_id").agg(F.sum("value").alias("t")), str(tmp_path / "t"), "complete")
    assert sorted(map(tuple, got.collect())) == batch
    state = W.run_once(W.goals(stream, 20.0), str(tmp_path / "g"), "update")
    last = {r.user_id: r.total for r in state.groupBy("user_id").agg(F.max("total").alias("total")).collect()}
    assert sorted(last.items()) == batch
    assert W.sessions(df, "90 minutes").count() == W.run_once(W.sessions(stream, "90 minutes"), str(tmp_path / "s"), "complete").count()
