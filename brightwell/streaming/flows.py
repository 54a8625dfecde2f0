"""Ready-made streaming queries: sources in, appended logs out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from brightwell.operators import cdc
from brightwell.streaming.sinks import GONE, append_batch

#: Defaults; the functions take a watermark as an argument.
WATERMARK, VIEW_WATERMARK = "10 minutes", "1 day"
SEQUENCE_BLOCK = 10_000_000
METRIC_SEQUENCE = ("last_sample_at", "samples")


def start(df: DataFrame, checkpoint: str, each_batch, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """A query that hands every micro-batch to ``each_batch``; by default it drains what is there and stops."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).foreachBatch(each_batch).start()


def append_to(df: DataFrame, checkpoint: str, path: str, trigger: dict | None = None) -> StreamingQuery:
    """Plain appends with the exactly-once file sink."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option(
        "path", path).trigger(**(trigger or {"availableNow": True})).start()


def apply_change_stream(changes: DataFrame, path: str, checkpoint: str, seq: str, day: str | None = None,
                        trigger: dict | None = None) -> StreamingQuery:
    """Change events appended to a log partitioned by day, or by blocks of the sequence where there is no moment.

    Deletions are kept as marked rows; :func:`sinks.read_current` resolves the log by key and sequence. The file sink
    writes every batch exactly once, and no batch reads what is stored.
    """
    part = F.to_date(day) if day else F.floor(F.col(seq) / SEQUENCE_BLOCK)
    shaped = changes.withColumns({GONE: F.col("op_type") == "DELETE", "part": part}).drop("op_type")
    return shaped.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option(
        "path", path).partitionBy("part").trigger(**(trigger or {"availableNow": True})).start()


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the progress reports the query still holds.

    Store the number with the run: rows dropped here are missing from the result.
    """
    return sum(int(state["numRowsDroppedByWatermark"]) for report in query.recentProgress for state in report["stateOperators"])


def minute_metric_stream(samples: DataFrame, path: str, checkpoint: str, ts: str = "sampled_at",
                         trigger: dict | None = None, watermark: str = WATERMARK) -> StreamingQuery:
    """Minute roll-ups appended as they grow; the one with the latest sample, then the most samples, is current.

    Late samples inside the watermark update their minute, later ones are counted by :func:`dropped_late`. Read with
    ``read_current(spark, path, ["pipeline_id", "minute_at"], METRIC_SEQUENCE, "day")``.
    """
    timed = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    minutes = cdc.minute_metrics(timed, ts, F.max(ts).alias("last_sample_at"), F.count("*").alias("samples"))

    def add(batch: DataFrame, _) -> None:
        append_batch(batch.withColumn("day", F.to_date("minute_at")), path, "day")

    return start(minutes, checkpoint, add, "update", trigger)


def view_count_stream(views: DataFrame, path: str, checkpoint: str, ts: str = "ts",
                      trigger: dict | None = None, watermark: str = VIEW_WATERMARK) -> StreamingQuery:
    """Daily view counters appended as they grow; the highest count of a table and day is current."""
    timed = views.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    # The window keeps the state bounded: a day's counters are dropped once the watermark has passed it.
    daily = timed.groupBy("table_id", F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("view_count")).select(
        "table_id", F.to_date("w.start").alias("view_date"), "view_count")

    def add(batch: DataFrame, _) -> None:
        append_batch(batch.withColumn("day", F.col("view_date")), path, "day")

    return start(daily, checkpoint, add, "update", trigger)


def session_stream(events: DataFrame, keys: Sequence[str], gap: str, ts: str, *aggregates: Column,
                   watermark: str = WATERMARK) -> DataFrame:
    """Sessions of a key: rows at most ``gap`` apart, with their start, end (last row plus gap) and number of rows.

    A row between two sessions joins them into one. A session is given out once the watermark has passed its end; rows
    behind the watermark are dropped and counted by :func:`dropped_late`.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return cdc.sessions(timed, keys, gap, ts, *aggregates)


def lake_sink(events: DataFrame, mapping: DataFrame, path: str, checkpoint: str,
              trigger: dict | None = None) -> StreamingQuery:
    """Raw change events appended per sink table."""
    routed = cdc.route_tables(events, mapping)
    return routed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option(
        "path", path).partitionBy("sink_table").trigger(**(trigger or {"availableNow": True})).start()


__all__ = ["append_to", "apply_change_stream", "dropped_late", "lake_sink", "minute_metric_stream", "session_stream", "start",
           "view_count_stream"]
