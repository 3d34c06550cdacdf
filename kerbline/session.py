"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Runtime settings every plan of this package relies on. AQE merges small shuffle partitions and splits
# skewed ones, so the initial number of partitions can be generous on a cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Call sites of Column functions cost several calls into the JVM each; plans here are built from many of them.
BUILD_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app_name: str = "kerbline", master: str | None = None, shuffle_partitions: int = 4096,
                  **conf: str) -> SparkSession:
    """A session for a cluster, or for `local[n]` when `master` says so."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**RUNTIME_CONF, **BUILD_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session that somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="kerbline-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for results that a later job reads back.

    The cluster names the shared parent in `spark.checkpoint.dir`. Only a local session may do without it; then one
    folder of this process serves, and the session's settings stay as they are.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if parent is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        parent = _local_dir()
    return f"{parent.rstrip('/')}/{purpose}-{uuid.uuid4()}"
