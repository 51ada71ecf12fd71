"""What the fourth review found."""

import random

import duckdb
from pyspark.sql import functions as F

from foliomill import registry


def test_f2_goal_is_reached_as_in_the_sql(spark, tmp_path):
    """Sums of cents that are 900.00 in decimals, and more, less or as much in doubles."""
    rng, rows = random.Random(3), []
    for user in range(60):
        cuts = [0, *sorted(rng.sample(range(1, 90_000), 8)), 90_000]
        values = [(b - a) / 100 for a, b in zip(cuts, cuts[1:])] + [5.0]
        rows += [(1_000 * i + user, f"2024-01-{i + 1:02} 10:00:00", user, "view", v, "{}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r[4] for r in con.execute(registry.oracle_sql()["goal_running_total"]).fetchall()}
    assert len({t.day for t in want.values()}) == 2
    assert {r.user_id: r.reached_at for r in registry.queries()["goal_running_total"](spark, str(tmp_path)).collect()} == want


def test_f4_spans_meet_as_arrays_of_a_block(spark, tmp_path, monkeypatch):
    """Sets of common words that seldom meet: not a row for each document that holds the first of them."""
    from foliomill.functions import text as X
    from foliomill.operators import fusion

    monkeypatch.setattr(fusion, "FIRST_SLICE", 8)
    monkeypatch.setattr(fusion, "BLOCK", 32)
    monkeypatch.setattr(fusion, "shared_folder", lambda s: str(tmp_path))
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=2))) for i in range(-30, 470)] + [(None, "a b")]
    asked = [(q, " ".join(rng.sample("abcdefghz", k=rng.randint(1, 4)))) for q in range(40)]
    got = fusion.by_rarest(spark.createDataFrame(asked, "question long, text string"), spark.createDataFrame(docs, "id long, text string"), X.tokens(F.col("text")), 3, 12)
    held = {i: set(t.split()) for i, t in docs}
    often = {w: sum(w in s for s in held.values()) for w in "abcdefgh"}
    want = set()
    for q, text in asked:
        few = set(sorted((w for w in text.split() if often.get(w)), key=lambda w: (often[w], w))[:3])
        best = sorted((i for i in held if few & held[i]), key=lambda i: (-len(few & held[i]), i is not None, i or 0))[:12]
        want |= {(q, i, n + 1) for n, i in enumerate(best)}
    assert set(map(tuple, got.collect())) == want
    (folder,) = tmp_path.glob("rarest-*")
    lists = spark.read.parquet(f"{folder}/postings").select("span", "slice", "block", F.size("ids").alias("n")).collect()
    assert len({(r.span, r.slice, r.block) for r in lists}) == len(lists) and max(r.block for r in lists) > 0
    assert {w: sum(r.n for r in lists if r.span == w) for w in often} == often and len(lists) * 2 < sum(often.values())
