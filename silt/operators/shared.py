"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _local(app: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='silt-')}"


def root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset, a temporary folder if driver and executors are one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local(spark.sparkContext.applicationId)
