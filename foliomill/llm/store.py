"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder.  Writing an intermediate there cuts
its lineage: a lost executor costs the tasks it was running, not the stages
before the table.  Tables are ordinary Parquet, compressed and column-pruned on
reading, and sit under the application's id so they can be dropped by folder.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark drops an execution's shuffle files when it ends
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_fallback: dict[str, str] = {}
_lock = threading.Lock()
_writing: dict[str, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder.  Where the session names none, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/foliomill/{app}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="foliomill-")
    return _fallback[app]


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """``CLEAN_UP`` is on while any write of the application runs, and then as it was before the first."""
    app = spark.sparkContext.applicationId
    with _lock:
        state = _writing.setdefault(app, [0, spark.conf.get(CLEAN_UP)])
        state[0] += 1
        spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(CLEAN_UP, state[1])
                del _writing[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return a reader of the written table.

    The write's shuffle files are removed with it: the table stands in for them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliomill_path = path
    return out


#: rows of a table of ids that may be broadcast
MOST = 200_000


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """A written table of ids, to be broadcast if it has at most ``most`` rows and joined by shuffle beyond."""
    return F.broadcast(df) if df.count() <= most else df


def drop(df: DataFrame) -> None:
    """Delete a written table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._foliomill_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
