"""Session and scratch-folder helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Recording the Python line of every column expression costs more than small queries do.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tilewright")
    # Small inputs: keep every core busy instead of merging partitions up to 1 MB.
    builder = builder.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Only where that is unset and the master is local a temporary folder is used; on
    a cluster machines do not share one, so an unset folder is an error there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        base = re.sub("^file:/*", "/", shared).rstrip("/")
    elif spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base}/tilewright-{label}-{uuid.uuid4().hex}"
