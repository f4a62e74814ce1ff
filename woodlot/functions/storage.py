"""Tables that cut lineage: written to the folder in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows and bytes a row is broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "woodlot-shared")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int = 200) -> DataFrame:
    """df with a broadcast hint if its counted size is within the bound; df should be a written table."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
