"""Change logs that are appended to and resolved on reading.

A micro-batch only adds files, so what it writes is bounded by the batch. A row carries its key and a sequence taken
from the data; the row with the highest sequence is the current one, and a batch that runs twice adds equal rows that
change nothing. Deletions are rows too.

From time to time ``compact`` resolves the log into a base beside it and records which files went in. From then on a read
touches the base and the tail, the files that came later. Files and not sequences part the two, so a change that arrives
late is in the tail whatever its sequence; the base keeps deletions, so an older change cannot bring a row back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from brightwell.operators.cdc import latest_changes

GONE = "is_deleted"


def append_batch(batch: DataFrame, path: str, partition: str) -> None:
    """Adds the rows of a micro-batch, marked as alive unless they say otherwise."""
    if GONE not in batch.columns:
        batch = batch.withColumn(GONE, F.lit(False))
    batch.write.mode("append").partitionBy(partition).parquet(path)


def compacted(log: DataFrame, key: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The last row of every key, deletions included. ``seq`` lists the columns of the sequence, most telling first."""
    order = log.withColumn("_order", F.struct(*seq))
    return latest_changes(order, key, "_order").select(*log.columns)


def _records(spark: SparkSession, path: str) -> DataFrame | None:
    """(version, file) of all compactions of a log; None before the first."""
    try:
        return spark.read.schema("version long, file string").parquet(f"{path}_base/records")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def base_and_tail(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The last base of a log, if there is one, and the rows of the files that came after it, if there are any."""
    log, records = spark.read.parquet(path), _records(spark, path)
    if records is None:
        return None, log
    last = records.groupBy("version").agg(F.collect_set("file").alias("files")).orderBy(F.desc("version")).first()
    base = spark.read.schema(log.schema).parquet(f"{path}_base/version={last.version}")
    later = sorted(set(log.inputFiles()) - set(last.files))
    return base, spark.read.schema(log.schema).option("basePath", path).parquet(*later) if later else None


def compact(spark: SparkSession, path: str, key: Sequence[str], seq: Sequence[str]) -> int:
    """Resolves base and tail into a new base and returns its version.

    The record of the files is written last and makes the base valid, so a compaction that fails leaves the old base in
    place; one that finds nothing new changes nothing.
    """
    base, tail = base_and_tail(spark, path)
    records = _records(spark, path)
    version = 0 if records is None else records.agg(F.max("version")).first()[0]
    if tail is None:
        return version
    files = spark.read.parquet(path).inputFiles()
    seen = set(tail.inputFiles()) | (set() if records is None else {
        r.file for r in records.filter(F.col("version") == version).select("file").toLocalIterator()})
    rows = tail if base is None else base.unionByName(tail)
    compacted(rows, key, seq).write.mode("overwrite").parquet(f"{path}_base/version={version + 1}")
    done = [(version + 1, f) for f in files if f in seen]
    spark.createDataFrame(done, "version long, file string").coalesce(1).write.mode("append").parquet(f"{path}_base/records")
    return version + 1


def read_current(spark: SparkSession, path: str, key: Sequence[str], seq: Sequence[str], *hidden: str) -> DataFrame:
    """Live rows of an appended log, from its last base and what came after it."""
    base, tail = base_and_tail(spark, path)
    rows = tail if base is None else base if tail is None else base.unionByName(tail)
    return compacted(rows, key, seq).filter(~F.col(GONE)).drop(GONE, *hidden)
