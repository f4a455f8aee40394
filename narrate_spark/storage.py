"""Intermediate tables in the folder that all executors share.

A cluster names that folder in ``spark.checkpoint.dir``.  Only a local session
without the setting, where there is one machine, gets a temporary folder.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and every executor can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        root = _local_root()
    return f"{root.rstrip('/')}/narrate-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """Write rows into the shared folder and read them again.

    What is read twice is computed once, and a lost executor costs its running
    tasks only.
    """
    folder = shared_dir(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
