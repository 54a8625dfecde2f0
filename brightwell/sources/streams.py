"""Stream sources with bounded intake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Topics of change events, and where reading starts per mode.
TOPICS = "cdc-events-.*"
OFFSETS = {"LATEST": "latest", "EARLIEST": "earliest"}
STARTS = ("INITIAL", *OFFSETS)
NO_EARLIEST = ("postgresql",)


def start_options(start: str, source_kind: str, snapshot_ms: int | None = None) -> dict[str, str]:
    """Where the change topic is read from.

    INITIAL reads a snapshot elsewhere and goes on from ``snapshot_ms``, a moment before that snapshot began, so no change
    made meanwhile is lost; those the snapshot already holds come again and lose nothing, as rows go by sequence.
    """
    if start not in STARTS:
        raise ValueError(f"unknown start {start}")
    if start == "EARLIEST" and source_kind in NO_EARLIEST:
        raise ValueError(f"{source_kind} cannot start from the earliest change")
    if start != "INITIAL":
        return {"startingOffsets": OFFSETS[start]}
    if snapshot_ms is None:
        raise ValueError("INITIAL needs the moment before the snapshot")
    return {"startingTimestamp": str(snapshot_ms), "startingOffsetsByTimestampStrategy": "latest"}


def kafka_events(spark: SparkSession, servers: str, start: str = "LATEST", source_kind: str = "mysql",
                 max_offsets: int = 1_000_000, topics: str = TOPICS, snapshot_ms: int | None = None) -> DataFrame:
    """Raw change events of all topics, shaped for ``normalize_cdc``. Needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**{
        "kafka.bootstrap.servers": servers, "subscribePattern": topics, "maxOffsetsPerTrigger": str(max_offsets),
        **start_options(start, source_kind, snapshot_ms)}).load()
    return raw.select("topic", F.col("timestamp").alias("kafka_ts"), F.col("value").cast("string").alias("value"),
                      F.struct("partition", "offset").alias("position"))


def file_events(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None,
                max_bytes: str | None = None, kind: str = "parquet") -> DataFrame:
    """Files as they arrive, at most so many files or bytes per micro-batch."""
    reader = spark.readStream.schema(schema).format(kind)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path)
