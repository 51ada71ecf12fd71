"""Order-dependent analytics as windows: gaps, islands, streaks, renumbering, goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def gaps(df: DataFrame, key: str, index: str, from_one: bool = False) -> DataFrame:
    """(key, n, missing, complete): whole numbers absent between the first (or 1) and the last index."""
    whole = F.col(index) == F.floor(index)
    per = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(F.when(whole, F.col(index).cast("int"))).alias("have"), F.max(F.floor(index)).cast("int").alias("hi"), F.min(F.floor(index)).cast("int").alias("lo"), F.bool_and(whole).alias("whole"), F.countDistinct(index).alias("d"),
    )
    low = F.lit(1) if from_one else F.col("lo")
    full = F.when(F.col("hi") >= low, F.sequence(low, F.col("hi"))).otherwise(F.array().cast("array<int>"))
    return per.select(key, "n", F.array_sort(F.array_except(full, "have")).alias("missing"), (F.col("whole") & (F.col("hi") == F.col("d"))).alias("complete"))


def gap_ranges(df: DataFrame, key: str, index: str) -> DataFrame:
    """(key, first, last): each run of missing numbers."""
    step = df.select(key, F.floor(index).cast("int").alias("i")).distinct().withColumn("next", F.lead("i").over(Window.partitionBy(key).orderBy("i")))
    return step.filter(F.col("next") > F.col("i") + 1).select(key, (F.col("i") + 1).alias("first"), (F.col("next") - 1).alias("last"))


def range_text(first: Column, last: Column) -> Column:
    """'#a' or '#a-#b'."""
    a, b = F.concat(F.lit("#"), first.cast("string")), F.concat(F.lit("#"), last.cast("string"))
    return F.when(first == last, a).otherwise(F.concat(a, F.lit("-"), b))


def reading_order(df: DataFrame, key: str, index: str, title: str, id_col: str = "id") -> DataFrame:
    """(key, n, titles, completion): titles in order and the share of 1..last that is there."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce(index, F.lit(0.0)).alias("i"), F.col(title).alias("t"), F.col(id_col).alias("id")))).alias("o"), F.max(F.floor(index)).alias("hi"), F.countDistinct(F.floor(index)).alias("d"))
    return per.select(key, "n", F.transform("o", lambda x: x["t"]).alias("titles"), F.round(F.coalesce(F.try_divide(100.0 * F.col("d"), F.col("hi").cast("double")), F.lit(0.0)), 1).alias("completion"))


def next_in_order(df: DataFrame, key: str, index: str, id_col: str = "id") -> DataFrame:
    """Each row with the id that follows it in its series."""
    w = Window.partitionBy(key).orderBy(F.coalesce(index, F.lit(0.0)), id_col)
    return df.withColumn("next_id", F.lead(id_col).over(w))


def bump_duplicates(df: DataFrame, key: str, index: str, id_col: str = "id", step: float = 0.1) -> DataFrame:
    """Later rows of one index get + ``step``; rows that change have ``changed``."""
    w = Window.partitionBy(key, index).orderBy(id_col)
    n = F.row_number().over(w)
    return df.withColumn("_n", n).withColumn("new_index", F.when(F.col("_n") > 1, F.col(index) + step).otherwise(F.col(index))).withColumn("changed", F.col("_n") > 1).drop("_n")


def renumber(df: DataFrame, key: str, index: str, id_col: str = "id") -> DataFrame:
    """1..n in index order; only rows that change."""
    w = Window.partitionBy(key).orderBy(F.coalesce(index, F.lit(0.0)), id_col)
    return df.withColumn("new_index", F.row_number().over(w).cast("double")).filter(~F.col("new_index").eqNullSafe(F.col(index)))


def normalise_series(df: DataFrame, name: str, index: str) -> DataFrame:
    """(id, field, old, new): names trimmed, indexes that are missing or negative set to 1."""
    fixed = F.when(F.col(index).isNull() | (F.col(index) < 0), 1.0).otherwise(F.col(index))
    change = F.array(F.struct(F.lit("name").alias("field"), F.col(name).alias("old"), F.trim(name).alias("new")), F.struct(F.lit("index").alias("field"), F.col(index).cast("string").alias("old"), fixed.cast("string").alias("new")))
    return df.select("id", F.explode(change).alias("c")).select("id", "c.*").filter(~F.col("old").eqNullSafe(F.col("new")))


def merge_series(df: DataFrame, key: str, index: str, source: str, target: str) -> DataFrame:
    """The source's rows appended after the target's last index + 1."""
    top = df.filter(F.col(key) == target).agg(F.coalesce(F.max(index), F.lit(0.0)).alias("_top"))
    moved = df.crossJoin(F.broadcast(top))  # one row
    is_source = F.col(key) == source
    return moved.withColumn("new_key", F.when(is_source, target).otherwise(F.col(key))).withColumn("new_index", F.when(is_source, F.col(index) + F.col("_top") + 1).otherwise(F.col(index))).drop("_top")


def islands(df: DataFrame, key: list[str], day: str) -> DataFrame:
    """(key, first, last, days): runs of consecutive days."""
    days = df.select(*key, F.col(day).alias("d")).filter("d is not null").distinct()
    w = Window.partitionBy(*key).orderBy("d")
    runs = days.withColumn("run", F.date_sub("d", F.row_number().over(w)))
    return runs.groupBy(*key, "run").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("days")).drop("run")


def streaks(df: DataFrame, key: list[str], day: str, today: Column) -> DataFrame:
    """(key, total_days, current, longest, frequency) as of ``today``."""
    return islands(df, key, day).groupBy(*key).agg(
        F.sum("days").cast("long").alias("total_days"), F.coalesce(F.max(F.when(F.col("last") == today, F.col("days"))), F.lit(0)).cast("long").alias("current"), F.max("days").alias("longest"),
        F.round(F.sum("days") / (F.datediff(F.max("last"), F.min("first")) + 1), 6).alias("frequency"),
    )


def last_per_key(df: DataFrame, key: str, ts: str, n: int, tie: str = "id") -> DataFrame:
    """The newest ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def running_index(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A chunk index from 0 that runs across the sections of a key."""
    return df.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def added(value: str, over: WindowSpec | None = None) -> Column:
    """A sum that may be compared: to a millionth, since the last digits of a sum of doubles follow the order of its rows."""
    out = F.sum(value)
    return F.round((out if over is None else out.over(over)).cast("double"), 6)


def goal_progress(s: DataFrame, key: str, ts: str, value: str, target: float, tie: str = "id", exact: bool = True) -> DataFrame:
    """(key, total, progress, remaining, reached_at): a running sum against a target.

    Without ``exact`` the sum is that of the doubles in the order of the rows, which
    can fall short of a target that decimals reach.
    """
    w = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    run = s.withColumn("_sum", added(value, w) if exact else F.sum(value).over(w))
    return run.groupBy(key).agg(F.sum(value).cast("double").alias("total"), F.min(F.when(F.col("_sum") >= target, F.col(ts))).alias("reached_at")).select(key, "total", F.round(F.least(F.lit(100.0), F.col("total") * 100 / target), 2).alias("progress"), F.round(F.greatest(F.lit(0.0), target - F.col("total")), 2).alias("remaining"), "reached_at")


def goals_by_metric(sessions: DataFrame, goals: DataFrame, key: str = "user", ts: str = "start", tie: str = "id") -> DataFrame:
    """(key, metric, target, total, progress, reached_at) for every goal (key, metric, target) over its key's sessions.

    A metric is ``sessions`` (one each), ``minutes``, ``pages``, or ``books``: each
    book counts once, when a session first brings its ``progress_end`` to 0.9.  Goals
    of other metrics have a total of 0.
    """
    done = F.col("progress_end") >= 0.9
    first = F.min(F.when(done, F.struct(ts, tie))).over(Window.partitionBy(key, "book"))
    rows = sessions.withColumn("_book", F.coalesce((done & (F.struct(ts, tie) == first)).cast("double"), F.lit(0.0)))
    amount = lambda metric, c: F.struct(F.lit(metric).alias("metric"), F.coalesce(c.cast("double"), F.lit(0.0)).alias("amount"))
    each = F.array(amount("sessions", F.lit(1)), amount("minutes", F.col("minutes")), amount("pages", F.col("pages")), amount("books", F.col("_book")))
    parts = rows.select(key, ts, tie, F.explode(each).alias("x")).select(key, ts, tie, "x.*")
    run = parts.withColumn("_sum", added("amount", Window.partitionBy(key, "metric").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)))
    out = goals.select(key, "metric", "target").join(run, [key, "metric"], "left").groupBy(key, "metric", "target")
    out = out.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"), F.min(F.when(F.col("_sum") >= F.col("target"), F.col(ts))).alias("reached_at"))
    share = F.coalesce(F.try_divide(F.col("total") * 100, F.col("target")), F.lit(100.0))
    return out.select(key, "metric", "target", "total", F.round(F.least(F.lit(100.0), share), 2).alias("progress"), "reached_at")


def daily_target(remaining: Column, days_left: Column) -> Column:
    """Amount for each day that is left, the present one included."""
    return remaining / (days_left + 1)
