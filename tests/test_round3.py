"""What the third review found."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill import registry
from foliomill.functions import scalars as S
from foliomill.operators import sequence, vectorindex, vectors


def test_f6_dayparts_of_equal_sums_tie(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02}:00:00", 1, "view", v, '{"k": 1}') for i, (h, v) in enumerate([(6, 0.3), (6, 0.3), (18, 0.1), (18, 0.2), (18, 0.3), (23, 0.6)])]
    rows += [(i + 100, t, 2, k, 0.6 if "06:" in t and i == 0 else 0.0 if "06:" in t else v, p) for i, t, _, k, v, p in rows]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user: r.favourite for r in registry.queries()["favourite_daypart"](spark, str(tmp_path)).collect()}
    assert got == {1: "night", 2: "night"}  # all three have 0.6; the greatest name counts


def test_f7_goal_is_reached_by_the_exact_sum(spark):
    rows = [(1, i, v) for i, v in enumerate([0.7, 0.1, 0.1, 5.0])]  # 0.8999999999999999 in doubles
    df = spark.createDataFrame(rows, "k long, id long, v double")
    assert sequence.goal_progress(df, "k", "id", "v", 0.9).first().reached_at == 2


@pytest.mark.parametrize(("v", "expected"), [(0.125, "0.12 B"), (0.375, "0.38 B"), (1024 * 2.125, "2.12 KB"), (float("inf"), "Infinity TB"), (2.0**43, "8.00 TB")])
def test_f8_sizes_round_from_the_double(spark, v, expected):
    assert spark.createDataFrame([(v,)], "v double").select(S.human_size(F.col("v"))).first()[0] == expected


def test_f8_human_size_equals_sql_on_the_larger_tables(spark):
    d = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("part", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    expected = con.execute(registry.oracle_sql()["human_size"]).fetchall()
    assert sorted(map(tuple, registry.queries()["human_size"](spark, d).collect())) == sorted(expected)


def test_f9_equal_texts_tie_by_id(spark):
    words = " ".join(f"w{i}x " * (1 + i % 7) for i in range(200)).split()
    docs = spark.createDataFrame([(i, " ".join(words[i * 13 :] + words[: i * 13])) for i in range(40)] + [(99, "other words")], "id long, t string").repartition(5)
    assert [r.id for r in vectors.recommend(vectors.tfidf(docs, "id", "t"), 20, 8).collect()] == list(range(8))
    assert [r.id for r in vectors.recommend_for(docs, "id", "t", " ".join(words), 8).collect()] == list(range(8))


def test_f2_f3_f4_a_query_goes_once_to_a_run_of_lists(spark, tmp_path, monkeypatch):
    """Where bounds leave no list out, a query's vector is not sent to each of them."""
    x = np.random.default_rng(4).normal(size=(600, 40))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    index = vectorindex.VectorIndex(spark, str(tmp_path / "v")).build(rows, list_rows=10)
    sent, real = [], vectorindex.blocks_of
    monkeypatch.setattr(vectorindex, "blocks_of", lambda rows, asked, lengths, kept: sent.append(asked.count()) or real(rows, asked, lengths, kept))
    asked = rows.filter("id % 20 = 0").selectExpr("id as query_id", "vector as query")
    got = {(r.query_id, r["rank"]): r.id for r in index.nearest(asked, 3, leave_out_own=True).collect()}
    for q in range(0, 600, 20):
        d = np.square(x - x[q]).sum(1)
        d[q] = np.inf
        assert [got[q, k] for k in (1, 2, 3)] == list(np.argsort(d)[:3])
    assert sum(sent) <= 2 * 30  # one run, in each of the two searches


def test_f5_equal_values_are_compared_once(spark):
    """Ten thousand rows of four values in one block are fifty million pairs, of which no value needs more than sixteen."""
    from foliomill.operators import dedupe

    rows = [(i, "b", ["red ring", "red bolt", "x"][i % 3], ["A", "B", None][i % 2 + (i % 7 == 0)]) for i in range(90)] + [(99, None, "red ring", "A")]
    df = spark.createDataFrame(rows, "id long, block string, title string, tag string")
    fields = {"title": ("text", 0.5), "tag": ("exact", 0.4)}
    got = dedupe.weighted_duplicates(df, F.col("block"), fields, 0.6)
    like = lambda a, b: 1.0 if a == b else 0.5 if {a, b} == {"red ring", "red bolt"} else 0.0
    want = {(i, j): (0.5 * like(t, u) + 0.4 * (x == y)) / 0.9 for i, b, t, x in rows for j, c, u, y in rows if i < j and b == c == "b" and x and y}
    want = {k: v for k, v in want.items() if v >= 0.6}
    assert {(r.a, r.b): pytest.approx(r.similarity) for r in got.collect()} == want
    many = spark.range(10_000).selectExpr("id", "'b' as block", "array('red ring', 'red bolt', 'blue ring', 'xx')[id % 4] as title", "'A' as tag")
    plan = dedupe.weighted_duplicates(many, F.col("block"), fields, 0.6)
    assert "levenshtein" in (text := plan._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" in text


def test_f1_probes_are_sent_in_bounded_pieces(monkeypatch):
    """A query that reads every list has its vector copied for each: few copies are held at once."""
    from foliomill.llm import neighbours

    x = np.random.default_rng(7).normal(size=(300, 16))
    lists = neighbours.Lists(np.hstack([x, np.zeros((300, 1))]), np.column_stack([np.roll(np.arange(300), 1), np.roll(np.arange(300), -1)]), 9.0, 16, x[:30], np.zeros(30, int))
    frames, sizes = [], []

    class Context:
        broadcast = staticmethod(lambda v: type("Value", (), {"value": v}))

    class Asked:
        sparkSession = type("Session", (), {"sparkContext": Context})

        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            import pandas as pd

            for out in run(iter([pd.DataFrame({"h": [str(i) for i in range(200)], "v": list(x[:200])})])):
                frames.append(out)
                sizes.append(len(out))

    monkeypatch.setattr(neighbours, "SENT", 1_000)
    neighbours.probes(Asked(), lists, {i: 1 for i in range(300)}, 21, ratio=100.0)
    assert sum(sizes) == 200 * 300 and max(sizes) <= 1_000
    assert {(h, w) for f in frames for h, w in zip(f["h"], f["list"])} == {(str(i), j) for i in range(200) for j in range(300)}
