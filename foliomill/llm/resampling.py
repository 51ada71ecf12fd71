"""Importance resampling towards a target distribution, over hashed n-gram features.

A dictionary of the distinct feature strings is counted once for all texts; each
distinct string is hashed once, buckets add up the dictionary's counts, and a
bucket's gain goes back through the dictionary to the features of each document.

The commonest features (those with at least one in ``FREQUENT`` of all places, so
at most ``FREQUENT`` strings) go to the tasks as a table; only a document's other
features move, to be joined with the dictionary, and none of them is a hot key.

Cases: a null text has no features and weight 0; equal rows are rows of their own
and score alike; a null ``doc_id`` draws as the empty string and comes after others
among ties; an empty table gives an empty one; without target texts all gains follow
from counts of 0.  Columns besides ``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import ascii_lower, flushed
from .store import materialize, partitions

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: strings in the table of common features
FREQUENT = 50_000
#: code points of a feature that stands for itself as a key; longer ones are keyed by digest
KEY_CHARS = 64


def words(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text)) if text else []


def features(found: list[str], longest: int) -> list[str]:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""
    out = list(found)
    for n in range(2, longest + 1):
        out += [" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
    return out


def key(feature: str) -> str:
    """The feature, or a digest (no feature starts with a space) where it is long."""
    return feature if len(feature) <= KEY_CHARS else " " + hashlib.sha256(feature.encode()).hexdigest()


def key_column(feature):  # noqa: ANN001, ANN201
    return F.when(F.length(feature) <= KEY_CHARS, feature).otherwise(F.concat(F.lit(" "), F.sha2(feature.cast("binary"), 256)))


def feature_counts(texts: DataFrame, longest: int = 1) -> DataFrame:
    """(feature, n) over all of ``texts.text``."""

    def add(total: Counter, batch: pa.RecordBatch, row: int) -> None:
        total.update(features(words(batch.column(0)[row].as_py()), longest))

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda b: flushed(b, add, "feature"), "feature string, n long")
    return rows.groupBy("feature").agg(F.sum("n").alias("n"))


def dictionary(source: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(feature, s, t, bucket): each distinct string with its counts, hashed once."""
    counted = feature_counts(source, longest).select("feature", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    counted = counted.unionByName(feature_counts(target, longest).select("feature", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    summed = counted.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return summed.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def bucket_gains(distinct: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of the buckets that hold a feature: at most ``buckets`` rows."""
    by = materialize(distinct.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    all_s, all_t = by.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * F.lit(float(all_s + buckets)) / ((d("s") + 1) * F.lit(float(all_t + buckets)))
    return by.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


ROW = "doc_id long, n_words long, n_features long, part long, rare array<struct<key:string,n:long>>"


def document_features(docs: DataFrame, common: dict[str, int], longest: int) -> DataFrame:
    """Each row's numbers of words and features, gains of its common features, and counts of the others."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            n_words, n_features, part, ends, keys, counts = [], [], [], [0], [], []
            first = 0

            def made(a: int, b: int) -> pa.RecordBatch:
                pairs = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64())], names=["key", "n"])
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
                return pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(x, pa.int64()) for x in (n_words, n_features, part)), rare], names=["doc_id", "n_words", "n_features", "part", "rare"])

            for row in range(batch.num_rows):
                found = words(batch.column(1)[row].as_py())
                counted = Counter(features(found, longest))
                gained = 0
                for f, n in counted.items():
                    k = f if len(f) <= KEY_CHARS else key(f)
                    gain = known(k)
                    if gain is None:
                        keys.append(k)
                        counts.append(n)
                    else:
                        gained += gain * n
                n_words.append(len(found))
                n_features.append(sum(counted.values()))
                part.append(gained)
                ends.append(len(keys))
                if len(keys) > 200_000:
                    yield made(first, row + 1)
                    first, n_words, n_features, part, ends, keys, counts = row + 1, [], [], [], [0], [], []
            yield made(first, batch.num_rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROW)


def weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, frequent: int = FREQUENT) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) for every row of ``docs``."""
    distinct = materialize(dictionary(docs, target, longest, buckets), "features")
    gains = materialize(distinct.join(F.broadcast(bucket_gains(distinct, buckets)), "bucket").select(key_column(F.col("feature")).alias("key"), "s", "gain"), "gains")
    places = gains.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    is_common = (F.col("s") * frequent >= places) & (F.col("s") > 0)
    common = {r["key"]: r["gain"] for r in gains.filter(is_common).select("key", "gain").toLocalIterator()}
    rows = materialize(document_features(docs, common, longest).withColumn("row", F.monotonically_increasing_id()), "document_features")
    rare = rows.select("row", F.explode("rare").alias("f")).select("row", F.col("f.key").alias("key"), F.col("f.n").alias("n"))
    moved = rare.join(gains.filter(~is_common & (F.col("s") > 0)).select("key", "gain"), "key")
    none = F.lit(None).cast("long")
    parts = rows.select("row", "doc_id", "n_words", "n_features", "part").unionByName(
        moved.select("row", none.alias("doc_id"), none.alias("n_words"), none.alias("n_features"), (F.col("gain") * F.col("n")).alias("part"))
    )
    summed = parts.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "n_words", "n_features")], F.sum("part").alias("total"))
    floored = F.expr("CASE WHEN n_features > 0 THEN (total - pmod(total, n_features)) DIV n_features ELSE 0L END")
    return summed.withColumn("weight", floored).drop("total")


def noise(seed: int):  # noqa: ANN201
    """A Gumbel variate in thousandths that follows from the seed and ``doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, frequent: int = FREQUENT) -> DataFrame:
    """Every document's weight and score; ``rank`` numbers the drawn ones.

    Ranks are places in one order over all rows, made by ranges: a range's rows are
    numbered where they lie and get the number of rows in the ranges before them.
    """
    scored = weights(docs, target, longest, buckets, frequent).withColumn("score", F.col("weight") + noise(seed))
    may = F.col("n_words") >= least_words
    spark = docs.sparkSession
    order = [F.when(may, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    laid = scored.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(laid.drop("row"), "placed").withColumn("part", F.shiftright("place", 33))
    sizes = sorted((r["part"], r["rows"], r["may"]) for r in placed.groupBy("part").agg(F.count("*").alias("rows"), F.sum(may.cast("long")).alias("may")).collect())
    drawn = percent * sum(m for _, _, m in sizes) // 100
    before, at = [], 0
    for part, rows, _ in sizes:
        before.append((part, at))
        at += rows
    offsets = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(offsets, "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"), "n_words")
