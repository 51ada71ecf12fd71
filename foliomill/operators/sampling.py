"""Exact samples, mergeable counts of distinct values, and a table function over ordered partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def stratified(df: DataFrame, stratum: str, quota: int | dict[str, int], key: Column, seed: str = "") -> DataFrame:
    """Exactly ``quota`` rows of each stratum (all, if it has fewer), in an order that follows from the key alone.

    The order is a hash of seed and key, so the sample is the same whatever the
    partitions, and grows without changing when a quota grows.  Tasks keep no more
    than the quota of a stratum before the shuffle.  A null stratum is one like others.
    """
    order = F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_order"))
    most = quota if isinstance(quota, int) else max(quota.values(), default=0)
    kept = df.withColumn("_order", order).withColumn("_place", place).filter(F.col("_place") <= most)
    if isinstance(quota, dict):
        own = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair]) if quota else F.create_map().cast("map<string,int>")
        kept = kept.filter(F.col("_place") <= F.coalesce(F.try_element_at(own, F.col(stratum).cast("string")), F.lit(0)))
    return kept.drop("_order", "_place")


def sketched(df: DataFrame, keys: list[str], value: str, lg: int = 12) -> DataFrame:
    """(keys, sketch): a mergeable sketch of the distinct values; a relative error of about 1.6 % at 12."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(lg)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, distinct): estimates over merged sketches, without the values."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


@udtf(returnType="user_id bigint, started bigint, ended bigint, n int")
class Runs:
    """Runs of rows at most ``gap`` apart, from a table partitioned by user and ordered by time; constant memory."""

    def __init__(self) -> None:
        self.run: list[int] | None = None

    def eval(self, row: Row, gap: int) -> Iterator[tuple]:
        at = row["at"]
        if self.run and at - self.run[2] > gap:
            yield tuple(self.run)
            self.run = None
        if self.run:
            self.run[2], self.run[3] = at, self.run[3] + 1
        else:
            self.run = [row["user_id"], at, at, 1]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


def runs(spark: SparkSession, events: DataFrame, gap: int) -> DataFrame:
    """(user_id, started, ended, n) over ``events`` (user_id, at), by the table function in SQL."""
    spark.udtf.register("runs", Runs)
    return spark.sql("SELECT * FROM runs(TABLE({events}) PARTITION BY user_id ORDER BY (at), {gap})".replace("{gap}", str(int(gap))), events=events)
