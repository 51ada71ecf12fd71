"""Order-dependent analytics: series gaps, streaks, renumbering, goals, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.operators import sequence as Q
from foliomill.plans.search import sql
from foliomill.registry import query
from foliomill.sources import catalog as C


@query(sql("SELECT series, count(*) AS n, array_to_string(list_sort(list_filter(generate_series(CAST(min(series_index) AS INT), CAST(max(series_index) AS INT)), lambda x: NOT list_contains(list(CAST(series_index AS INT)), x))), ',') AS missing FROM books GROUP BY series"))
def series_gaps(s: SparkSession, d: str) -> DataFrame:
    return Q.gaps(C.books(s, d), "series", "series_index").select("series", "n", F.array_join("missing", ",").alias("missing"))


@query(sql("SELECT series, count(*) AS n, array_to_string(list_sort(list_filter(generate_series(1, CAST(max(series_index) AS INT)), lambda x: NOT list_contains(list(CAST(series_index AS INT)), x))), ',') AS missing, max(series_index) = count(DISTINCT series_index) AS complete FROM books GROUP BY series"))
def series_missing_from_one(s: SparkSession, d: str) -> DataFrame:
    return Q.gaps(C.books(s, d), "series", "series_index", from_one=True).select("series", "n", F.array_join("missing", ",").alias("missing"), "complete")


@query(sql("SELECT series, CASE WHEN n = i + 2 THEN '#' || (i + 1) ELSE '#' || (i + 1) || '-#' || (n - 1) END AS gap FROM (SELECT series, i, lead(i) OVER (PARTITION BY series ORDER BY i) AS n FROM (SELECT DISTINCT series, CAST(series_index AS INT) AS i FROM books)) WHERE n > i + 1"))
def gap_ranges(s: SparkSession, d: str) -> DataFrame:
    return Q.gap_ranges(C.books(s, d), "series", "series_index").select("series", Q.range_text(F.col("first"), F.col("last")).alias("gap"))


@query(sql("SELECT series, count(*) AS n, array_to_string(list(title ORDER BY series_index, title, id), '; ') AS titles, round(100.0 * count(DISTINCT series_index) / max(series_index), 1) AS completion FROM books GROUP BY series"))
def series_reading_order(s: SparkSession, d: str) -> DataFrame:
    return Q.reading_order(C.books(s, d), "series", "series_index", "title").withColumn("titles", F.array_join("titles", "; "))


@query(sql("SELECT id, lead(id) OVER (PARTITION BY series ORDER BY series_index, id) AS next_id FROM books"))
def next_in_series(s: SparkSession, d: str) -> DataFrame:
    return Q.next_in_order(C.books(s, d), "series", "series_index").select("id", "next_id")


@query(sql("SELECT id, CASE WHEN row_number() OVER (PARTITION BY series, series_index ORDER BY id) > 1 THEN series_index + 0.1 ELSE series_index END AS new_index FROM books"))
def bump_duplicates(s: SparkSession, d: str) -> DataFrame:
    return Q.bump_duplicates(C.books(s, d), "series", "series_index").select("id", "new_index")


@query(sql("SELECT id, new_index FROM (SELECT id, series_index, CAST(row_number() OVER (PARTITION BY series ORDER BY series_index, id) AS DOUBLE) AS new_index FROM books) WHERE new_index <> series_index"))
def renumber_series(s: SparkSession, d: str) -> DataFrame:
    return Q.renumber(C.books(s, d), "series", "series_index").select("id", "new_index")


@query(sql("SELECT id, 'name' AS field, ' ' || series AS old, series AS new FROM books WHERE id % 9 = 0 UNION ALL SELECT id, 'index', '-1.0', '1.0' FROM books WHERE id % 11 = 0"))
def normalise_series(s: SparkSession, d: str) -> DataFrame:
    b = C.books(s, d).withColumn("series", F.when(F.col("id") % 9 == 0, F.concat(F.lit(" "), "series")).otherwise(F.col("series"))).withColumn("series_index", F.when(F.col("id") % 11 == 0, -1.0).otherwise(F.col("series_index")))
    return Q.normalise_series(b, "series", "series_index")


@query(sql("SELECT id, 'Brand#2' AS series, series_index + (SELECT max(series_index) FROM books WHERE series = 'Brand#2') + 1 AS series_index FROM books WHERE series = 'Brand#1'"))
def merge_series(s: SparkSession, d: str) -> DataFrame:
    return Q.merge_series(C.books(s, d), "series", "series_index", "Brand#1", "Brand#2").filter("series = 'Brand#1'").select("id", F.col("new_key").alias("series"), F.col("new_index").alias("series_index"))


_DAYS = """d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), r AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS run FROM d),
i AS (SELECT user_id, run, min(d) AS first, max(d) AS last, count(*) AS days FROM r GROUP BY 1, 2)"""


@query(f"WITH {_DAYS} SELECT user_id, CAST(sum(days) AS BIGINT) AS total_days, coalesce(max(days) FILTER (last = DATE '2024-01-30'), 0) AS current, max(days) AS longest, round(sum(days) / (max(last) - min(first) + 1), 6) AS frequency FROM i GROUP BY 1")
def reading_streaks(s: SparkSession, d: str) -> DataFrame:
    e = C.table(s, d, "events").select("user_id", F.to_date("ts").alias("day"))
    return Q.streaks(e, ["user_id"], "day", F.lit("2024-01-30").cast("date"))


@query(f"WITH {_DAYS} SELECT user_id, first, last, days FROM i WHERE days >= 5")
def long_streaks(s: SparkSession, d: str) -> DataFrame:
    e = C.table(s, d, "events").select("user_id", F.to_date("ts").alias("day"))
    return Q.islands(e, ["user_id"], "day").filter("days >= 5")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def last_n_per_user(s: SparkSession, d: str) -> DataFrame:
    return Q.last_per_key(C.table(s, d, "events"), "user_id", "ts", 5, "event_id").select("user_id", "event_id")


@query("SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1")
def first_hit_per_key(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS chunk_index FROM conversations")
def running_chunk_index(s: SparkSession, d: str) -> DataFrame:
    return Q.running_index(C.table(s, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "chunk_index")


@query("WITH r AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) SELECT user_id, round(sum(value), 4) AS total, round(least(100, sum(value) * 100 / 900), 2) AS progress, round(greatest(0, 900 - sum(value)), 2) AS remaining, min(ts) FILTER (run >= 900) AS reached_at FROM r GROUP BY 1")
def goal_running_total(s: SparkSession, d: str) -> DataFrame:
    out = Q.goal_progress(C.table(s, d, "events"), "user_id", "ts", "value", 900.0, "event_id", exact=False)
    return out.withColumn("total", F.round("total", 4))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
def moving_average(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return C.table(s, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("moving"))


@query("SELECT a.event_id, (SELECT max_by(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.event_type = 'view' AND b.user_id = a.user_id AND b.ts <= a.ts) AS view_id FROM events a WHERE a.event_type = 'purchase'")
def asof_last_view(s: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last view before it: one sorted window over both, no range join."""
    e = C.table(s, d, "events").filter("event_type in ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id")
    seen = e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.filter("event_type = 'purchase'").select("event_id", "view_id")


@query("SELECT s.event_id AS signup, count(e.event_id) AS n FROM events s LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type = 'click' AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 1 DAY WHERE s.event_type = 'signup' GROUP BY 1")
def range_join_clicks(s: SparkSession, d: str) -> DataFrame:
    """Clicks in the day after each sign-up: an equi-join on user and day bucket, then the exact range."""
    e = C.table(s, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    day = F.to_date("t")
    left = e.filter("event_type = 'signup'").select(F.col("event_id").alias("signup"), "user_id", F.col("t").alias("from"), F.explode(F.array(day, F.date_add(day, 1))).alias("day"))
    right = e.filter("event_type = 'click'").select("user_id", F.col("t").alias("at"), day.alias("day"))
    hit = (F.col("at") >= F.col("from")) & (F.col("at") < F.col("from") + F.expr("interval 1 day"))
    return left.join(right, ["user_id", "day"], "left").groupBy("signup").agg(F.count(F.when(hit, 1)).alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS returned, b.n AS heavy FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) b ON a.k = b.k")
def full_outer_counts(s: SparkSession, d: str) -> DataFrame:
    l = C.table(s, d, "lineitem")  # noqa: E741
    count = lambda test, name: l.filter(test).groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias(name))
    return count("l_returnflag = 'R' and l_quantity < 10", "returned").join(count("l_quantity > 45", "heavy"), "k", "full")
