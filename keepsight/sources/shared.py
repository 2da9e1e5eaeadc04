"""Places in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_base(spark: SparkSession) -> str | None:
    """The session's checkpoint folder, as set in its configuration or on its context."""
    return spark.conf.get(_CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()


def ensure_shared(spark: SparkSession) -> None:
    """Give a local session without a checkpoint folder one of its own.

    A cluster's folder is for its operator to name; there, nothing is made up.
    """
    if shared_base(spark):
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_SETTING} to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keepsight-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the session's checkpoint folder."""
    base = shared_base(spark)
    if not base:
        raise ValueError(f"set {_CHECKPOINT_SETTING} to a folder all executors share")
    return f"{base.rstrip('/')}/keepsight/{name}-{uuid.uuid4().hex}"
