"""Folders and column helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, a local master gets a folder of its own, as in tests; a cluster is refused.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = own_folder()
    return f"{base.rstrip('/')}/brightwell-{name}-{uuid.uuid4().hex}"


_own: list[str] = []


def own_folder() -> str:
    """A scratch folder of this process, made when first asked for."""
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="run-"))
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table: work done once, lineage cut, safe against loss."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, other characters untouched. Words without other characters take the cheaper built-in path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
