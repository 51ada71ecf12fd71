"""Sessions and windows over an event stream, and the same over a batch.

Every function takes either kind of DataFrame; a stream needs a watermark, which
bounds the state that late rows can touch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliomill.sources.versions import Versions


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A directory of event Parquet files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, ts: str = "ts", late: str | None = "10 minutes") -> DataFrame:
    """Event time as a timestamp, with a watermark if the frame streams."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late and events.isStreaming else out


def tumbling(events: DataFrame, width: str = "1 day", keys: tuple[str, ...] = ("event_type",), ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Counts and sums by time window."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = timed(events, ts).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, started, ended, n): runs of events less than ``gap`` apart."""
    out = timed(events, ts).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("ended"))
    return out.select(key, F.col("s.start").alias("started"), "ended", "n")


GOAL = "user_id long, total double, reached boolean"


def goals(events: DataFrame, target: float, key: str = "user_id", value: str = "value") -> DataFrame:
    """A running total per user against a target, kept as state across micro-batches."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        total += float(sum(f[value].sum() for f in frames))
        state.update((total,))
        yield pd.DataFrame({"user_id": [k[0]], "total": [total], "reached": [total >= target]})

    return events.groupBy(key).applyInPandasWithState(step, GOAL, "total double", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, as files in ``folder``; called again, it goes on from its checkpoint.

    Complete mode keeps the last batch, the others the rows of all batches.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        # a batch that is run again replaces what it wrote
        at = (lambda number: out) if mode == "complete" else (lambda number: f"{out}/batch={number}")
        writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(at(number))).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_latest`` has in ``path``."""
    v = Versions(spark, path)
    buckets = v.read().get("buckets", {})
    parts = [v.table(f"{name}/bucket={b}", schema) for b, name in sorted(buckets.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def merge_latest(batch: DataFrame, number: int, path: str, keys: list[str], ts: str, buckets: int = 64) -> list[int]:
    """The latest row of each key after a batch; the buckets of keys that were written anew.

    Keys are dealt in buckets by hash, and only buckets with keys of the batch are
    written.  The new state names old files for the others.  A batch whose number the
    state has already changes nothing.
    """
    from foliomill.operators.mutations import latest

    spark, v = batch.sparkSession, Versions(batch.sparkSession, path)
    state = v.read()
    if number <= state.get("batch", -1):
        return []
    held = state.get("buckets", {})
    rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # at most ``buckets``
    old = [v.table(f"{held[str(b)]}/bucket={b}", batch.schema).withColumn("bucket", F.lit(b)) for b in touched if str(b) in held]
    name = v.name("rows")
    merged = latest(reduce(DataFrame.unionByName, old, rows), [*keys, "bucket"], ts)
    if touched:
        v.write(merged.repartition("bucket"), name, "bucket")
    v.commit(state | {"batch": number, "buckets": held | {str(b): name for b in touched}})
    return touched


def write_latest(stream: DataFrame, path: str, keys: list[str], ts: str, checkpoint: str, buckets: int = 64):
    """Latest row per key, kept up by each micro-batch where it has keys; a replayed batch gives the same table."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: merge_latest(batch, number, path, keys, ts, buckets) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
