"""Statistics over catalogs and sessions, as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, key: Column, name: str = "key", limit: int | None = None) -> DataFrame:
    """Counts by key, most frequent first, ties by key."""
    out = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)
    return out.limit(limit) if limit else out


def histograms(df: DataFrame, keys: dict[str, Column], top: int | None = None) -> DataFrame:
    """(field, value, n) of several fields in one pass: rows are expanded once, then counted."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), c.cast("string").alias("value")) for k, c in keys.items()])
    counted = df.select(F.explode(pairs).alias("x")).select("x.*").filter("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    if not top:
        return counted
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")


def first_letters(df: DataFrame, name: str) -> DataFrame:
    return histogram(df, F.upper(F.substring(F.col(name), 1, 1)), "letter")


def usage(entities: DataFrame, link: DataFrame, key: str) -> DataFrame:
    """Every entity with its number of books, unused ones with 0."""
    n = link.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("books"))
    return entities.join(n, "id", "left").withColumn("books", F.coalesce("books", F.lit(0)).cast("long"))


def usage_stats(used: DataFrame) -> DataFrame:
    """total, used, unused and mean number of books, unused ones included."""
    return used.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("books") == 0).alias("unused"), F.count_if(F.col("books") > 0).alias("used"), F.round(F.avg("books"), 6).alias("mean_books"))


def monthly(df: DataFrame, ts: str, year: int | None = None) -> DataFrame:
    """(year, month, n) in order; null dates are left out."""
    rows = df.filter(F.col(ts).isNotNull()).select(F.year(ts).alias("year"), F.month(ts).alias("month"))
    if year:
        rows = rows.filter(F.col("year") == year)
    return rows.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n")).orderBy("year", "month")


def coverage(df: DataFrame, filled: Column, length: Column) -> DataFrame:
    """Rows with and without a text, percentage, mean length as a whole number."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(filled).alias("with_text"), F.count_if(~filled).alias("without_text"), F.round(100.0 * F.count_if(filled) / F.count(F.lit(1)), 1).alias("percent"), F.floor(F.avg(F.when(filled, length))).cast("long").alias("mean_length"))


def exact_duplicates(df: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """Keys that several rows share, with their ids."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(id_col)).alias("ids")).filter("n > 1")


def _named(c: str) -> Column:
    """A list column's elements as (field, value)."""
    return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.struct(F.lit(c).alias("field"), v.cast("string").alias("value")))


def facets(df: DataFrame, plain: list[str], lists: list[str], top: int = 10) -> DataFrame:
    """(field, value, n): the most frequent values of plain and list fields."""
    parts = [F.array(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))) for c in plain]
    parts += [_named(c) for c in lists]
    counted = df.select(F.explode(F.concat(*parts)).alias("x")).select("x.*").filter("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def session_stats(s: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Sessions, minutes, pages, books, and the spread of pages per minute."""
    speed = F.try_divide(F.col("pages").cast("double"), F.when(F.col("minutes") > 0, F.col("minutes")))
    r = lambda c: F.round(c, 2)
    return s.withColumn("_v", speed).groupBy(*(key or [])).agg(
        F.count(F.lit(1)).alias("n_sessions"), r(F.sum("minutes")).alias("total_minutes"), F.sum("pages").cast("long").alias("total_pages"), F.countDistinct("kind").alias("n_kinds"),
        r(F.avg("minutes")).alias("mean_minutes"), r(F.avg("pages")).alias("mean_pages"), r(F.percentile("_v", 0.5)).alias("median_speed"), r(F.min("_v")).alias("min_speed"), r(F.max("_v")).alias("max_speed"),
    )


def favourite_hours(s: DataFrame, ts: str = "start", top: int = 3) -> DataFrame:
    return histogram(s, F.hour(ts), "hour", top)


def daily(s: DataFrame, ts: str, value: str) -> DataFrame:
    """(day, total) of the days that have rows."""
    return s.groupBy(F.to_date(ts).alias("day")).agg(F.sum(value).cast("double").alias("total"))


def dense_days(s: DataFrame, ts: str, value: str, days: int) -> DataFrame:
    """(day, total) of the last ``days`` + 1 days up to the newest row; missing days are 0."""
    span = s.agg(F.to_date(F.max(ts)).alias("last"))
    calendar = span.select(F.explode(F.sequence(F.date_sub("last", days), F.col("last"))).alias("day"))
    return calendar.join(daily(s, ts, value), "day", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def missing_metadata(books: DataFrame, tests: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Books that lack any child (a table of ids by name) or have a null column, with the reasons."""
    out = books
    for name, ids in tests.items():
        out = out.join(ids.select("id").distinct().withColumn(f"_{name}", F.lit(True)), "id", "left")
    reasons = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n in tests], *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return out.select("id", reasons.alias("missing")).filter(F.size("missing") > 0)


def health(checks: dict[str, tuple[Column, float]], df: DataFrame) -> DataFrame:
    """(check, value, status): ok up to each threshold, warning above."""
    row = df.agg(*[c.cast("double").alias(k) for k, (c, _) in checks.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("value"), F.when(F.col(k) <= t, "ok").otherwise("warning").alias("status")) for k, (_, t) in checks.items()])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def health_score(books: DataFrame, missing: DataFrame) -> DataFrame:
    """100 less the percentage of books with missing files, not below 0."""
    n = books.agg(F.count(F.lit(1)).alias("books"))
    m = missing.agg(F.count(F.lit(1)).alias("missing"))
    return n.crossJoin(m).select("books", "missing", F.round(F.greatest(F.lit(0.0), 100 - F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("books").cast("double")), F.lit(0.0))), 2).alias("score"))


def degrees(edges: DataFrame) -> DataFrame:
    """(user, followers, n): who follows whom."""
    return edges.dropDuplicates(["src", "dst"]).groupBy(F.col("dst").alias("user")).agg(F.array_sort(F.collect_set("src")).alias("followers"), F.count(F.lit(1)).alias("n"))


def one_row(parts: dict[str, DataFrame]) -> DataFrame:
    """Several single-row aggregates side by side."""
    return reduce(lambda a, b: a.crossJoin(b), parts.values())


#: fixed values: days of a period of reading history
PERIODS = {"day": 1, "week": 7, "month": 30, "year": 365}


def reading_habits(history: DataFrame, period: str, now: Column, start: str = "start", minutes: str = "minutes", tags: str = "tags", authors: str = "authors", top: int = 10) -> DataFrame:
    """(kind, value, n, minutes): totals of the sessions in the period, then the most read tags and authors, ties by name.

    ``period`` is day, week, month, year or all; ``tags`` and ``authors`` are lists,
    each of whose names counts once for a session.
    """
    if period != "all" and period not in PERIODS:
        raise ValueError(f"period is all or one of {', '.join(PERIODS)}")
    rows = history if period == "all" else history.filter(F.col(start) >= now - F.make_dt_interval(F.lit(PERIODS[period])))
    named = lambda kind, c: F.transform(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    total = F.array(F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("value")))
    each = rows.select(F.col(minutes).alias("m"), F.explode(F.concat(total, named("author", authors), named("tag", tags))).alias("x"))
    counted = each.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"), F.sum("m").alias("minutes"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    return counted.withColumn("_r", place).filter((F.col("_r") <= top) | (F.col("kind") == "total")).drop("_r")
