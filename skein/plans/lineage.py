"""Cutting lineage in loops by reliable checkpoints, or by tables where rows are many."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="skein-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder that spark.checkpoint.dir names; a folder of our own only where that is unset."""
    _folder(df)
    return df.checkpoint()


def stage(df: DataFrame) -> DataFrame:
    """df, written as a compressed table to that folder and read again: a few bytes a value where a checkpoint takes tens. It stays until the folder goes."""
    path = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
