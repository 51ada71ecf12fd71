"""Exact samples, merged sketches and a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import sampling
from foliomill.registry import query
from foliomill.sources import catalog as C


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s' || CAST(doc_id AS VARCHAR))) AS n FROM documents) WHERE n <= 25")
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    """Twenty-five documents of each language."""
    return sampling.stratified(C.table(s, d, "documents").select("doc_id", "lang"), "lang", 25, F.col("doc_id"), "s")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS n FROM documents) WHERE n <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 5 ELSE 0 END")
def stratified_quotas(s: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(C.table(s, d, "documents").select("doc_id", "lang"), "lang", {"en": 40, "de": 5}, F.col("doc_id"))


@query()
def merged_sketches(s: SparkSession, d: str) -> DataFrame:
    """Distinct users by type of event, from sketches by day and type."""
    e = C.table(s, d, "events").withColumn("day", F.to_date("ts"))
    return sampling.merged_sketches(sampling.sketched(e, ["day", "event_type"], "user_id"), ["event_type"])


@query("WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 21600000000 THEN 0 ELSE 1 END AS new FROM e), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM g) SELECT user_id, min(t) AS started, max(t) AS ended, CAST(count(*) AS INT) AS n FROM i GROUP BY user_id, r")
def runs_by_table_function(s: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events at most six hours apart, by a table function over partitions."""
    e = C.table(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return sampling.runs(s, e, 21_600_000_000)
