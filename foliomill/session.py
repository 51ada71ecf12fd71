"""A Spark session with the settings that the plans assume."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "foliomill", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, Arrow.  On a cluster leave ``shuffle_partitions`` to
    adaptive coalescing; in local mode set it to the number of cores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local mode, an error on a cluster without one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="foliomill-")
