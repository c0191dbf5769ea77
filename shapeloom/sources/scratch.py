"""Scratch tables in the folder that all executors share: iterations cut their lineage with files, never with local copies."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df once below spark.checkpoint.dir and go on from the files."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="shapeloom-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that never sends it to the driver: a table of millions of ids has files that look small enough for a broadcast."""
    return df.hint("merge")
