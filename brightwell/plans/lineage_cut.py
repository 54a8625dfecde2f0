"""Reliable lineage cuts for iterative jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session; only a local master may fall back to a scratch folder."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` with the number of rows, counted while they are written."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = Observation()
    cut = df.observe(rows, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    return cut, rows.get["n"]
