"""Samples by quota, sketches within their error, runs by a table function."""

import hashlib

from pyspark.sql import functions as F

from foliomill.operators import sampling


def test_quotas_are_exact_and_follow_the_key(spark):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else None)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, s string")
    order = lambda k, seed="": hashlib.md5(f"{seed}{k}".encode()).hexdigest()
    want = {s: set(sorted((k for k, x in rows if x == s), key=lambda k: order(k, "z"))[:20]) for s in ("a", "b", None)}
    for parts in (1, 7):
        got = sampling.stratified(df.repartition(parts), "s", 20, F.col("k"), "z").collect()
        assert {s: {r.k for r in got if r.s == s} for s in want} == want
    some = sampling.stratified(df, "s", {"a": 3, "b": 1000, "none": 5}, F.col("k")).collect()
    assert sum(r.s == "a" for r in some) == 3 and sum(r.s == "b" for r in some) == 50 and len(some) == 53
    assert sampling.stratified(df, "s", {}, F.col("k")).collect() == [] and sampling.stratified(df.limit(0), "s", 5, F.col("k")).collect() == []


def test_merged_sketches_are_near(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 10).alias("day"), (F.col("id") % 20_000).alias("v"))
    got = {r.g: r.distinct for r in sampling.merged_sketches(sampling.sketched(df, ["g", "day"], "v"), ["g"]).collect()}
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("v").alias("n")).collect()}
    assert set(got) == set(exact) and all(abs(got[g] / exact[g] - 1) < 0.06 for g in exact)


def test_runs(spark):
    df = spark.createDataFrame([(1, 0), (1, 5), (1, 11), (2, 3), (1, 30)], "user_id long, at long").repartition(3)
    assert sorted(map(tuple, sampling.runs(spark, df, 6).collect())) == [(1, 0, 11, 3), (1, 30, 30, 1), (2, 3, 3, 1)]
    assert sampling.runs(spark, df.limit(0), 6).collect() == []


def test_reading_habits_and_goals(spark):
    import datetime

    import pytest

    from foliomill.operators import sequence, stats

    day = lambda n: datetime.datetime(2024, 1, n)
    history = spark.createDataFrame([(day(1), 5, ["a"], ["x"]), (day(9), 7, ["a", "b", "a"], ["x", "y"]), (day(10), None, None, ["y"])], "start timestamp, minutes int, tags array<string>, authors array<string>")
    habits = lambda p: {(r.kind, r.value): (r.n, r.minutes) for r in stats.reading_habits(history, p, F.lit(day(10)).cast("timestamp"), top=2).collect()}
    assert habits("all") == {("total", None): (3, 12), ("tag", "a"): (2, 12), ("tag", "b"): (1, 7), ("author", "x"): (2, 12), ("author", "y"): (2, 7)}
    assert habits("week") == {("total", None): (2, 7), ("tag", "a"): (1, 7), ("tag", "b"): (1, 7), ("author", "x"): (1, 7), ("author", "y"): (2, 7)}
    with pytest.raises(ValueError):
        habits("decade")
    sessions = spark.createDataFrame([(1, 1, day(1), 10.0, 30, 7, 0.5), (1, 2, day(2), 10.0, None, 7, 0.95), (1, 3, day(3), 10.0, 30, 7, 1.0), (1, 4, day(4), 10.0, 1, 8, 0.9)], "user int, id int, start timestamp, minutes double, pages int, book int, progress_end double")
    goals = spark.createDataFrame([(1, "books", 2.0), (1, "pages", 60.0), (1, "sessions", 8.0), (2, "books", 1.0), (1, "naps", 1.0)], "user int, metric string, target double")
    got = {(r.user, r.metric): (r.total, r.progress, r.reached_at) for r in sequence.goals_by_metric(sessions, goals).collect()}
    assert got == {(1, "books"): (2.0, 100.0, day(4)), (1, "pages"): (61.0, 100.0, day(3)), (1, "sessions"): (4.0, 50.0, None), (2, "books"): (0.0, 0.0, None), (1, "naps"): (0.0, 0.0, None)}
