"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or under one of our own where that is unset and all run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not where:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="siftstream-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        where = f"file://{_own[0]}"
    return f"{where.rstrip('/')}/siftstream/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
