"""Change events and the metrics of change streams. Every function that has no ordering rule runs unchanged on batch
and streaming frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightwell.functions.values import ago, count_when, half_open, ntz
from brightwell.plans.topk import top_per_key
from brightwell.plans.two_level import previous_value, streaks

# Event shape, operation names, topic prefix, thresholds and windows.
EVENT_SCHEMA = ("op string, before map<string,string>, after map<string,string>, "
                "source struct<`table`:string>, ts_ms bigint")
OPERATIONS = {"c": "INSERT", "u": "UPDATE", "d": "DELETE"}
TOPIC = r"\Acdc-events-(-?\d+)\z"
LAG_WARN_SECONDS, NOT_FOUND_POLLS = 30, 3
LATENCY_SAMPLES, LATENCY_SHARE = 1024, 0.95
TREND_RANGES = {"1h": (1, "minute"), "6h": (6, "minute"), "24h": (24, "5 minutes"), "7d": (168, "hour")}
START_MODES = ("INITIAL", "LATEST", "EARLIEST")


def normalize_cdc(raw: DataFrame, now=None, value: str = "value", message_ts: str = "kafka_ts") -> DataFrame:
    """Change events with operation, table, row image, event time and latency.

    Unknown operations and unreadable messages are dropped. A message without its own time takes the time of the
    transport. The latency is measured against ``now``, the current time when none is given.
    """
    event = F.from_json(F.col(value), EVENT_SCHEMA)
    operation = F.coalesce(*[F.when(F.col("e.op") == k, v) for k, v in OPERATIONS.items()])
    sent = F.coalesce(F.col("e.ts_ms"), F.unix_millis(F.col(message_ts).cast("timestamp")))
    clock = F.unix_millis(F.current_timestamp() if now is None else ntz(now).cast("timestamp"))
    # Behind a generator the optimizer keeps one parse: neither the filter nor the columns below copy it.
    parsed = raw.select("*", F.explode(F.array(event)).alias("e"))
    kept = [c for c in raw.columns if c != value]
    return parsed.select(
        *kept, operation.alias("op_type"), F.col("e.source.table").alias("table"),
        F.coalesce("e.after", "e.before").alias("data"), sent.alias("event_ms"),
        F.greatest(clock - sent, F.lit(0)).alias("latency_ms")).filter(F.col("op_type").isNotNull())


def with_pipeline(events: DataFrame, topic: str = "topic") -> DataFrame:
    """The pipeline number of the topic; events of other topics are dropped."""
    number = F.regexp_extract(F.col(topic), TOPIC, 1).try_cast("bigint")
    return events.withColumn("pipeline_id", number).filter(F.col("pipeline_id").isNotNull())


def latest_changes(changes: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The last change of every key as an aggregation; each task sends one row per key."""
    rest = [c for c in changes.columns if c not in (*key, seq)]
    newest = changes.groupBy(*key).agg(F.max(seq).alias(seq), F.max_by(F.struct(*rest), F.col(seq)).alias("row"))
    return newest.select(*key, seq, "row.*")


def apply_changes(base: DataFrame, changes: DataFrame, key: Sequence[str], seq: str, op: str = "op_type",
                  start: str = "INITIAL") -> DataFrame:
    """Current rows after upserts and deletes. ``base`` has the key and the value columns.

    INITIAL starts from the snapshot; LATEST and EARLIEST build on the changes alone, the caller choosing from which
    position they are read.
    """
    if start not in START_MODES:
        raise ValueError(f"unknown start {start}")
    key = list(key)
    columns = base.columns
    newest = latest_changes(changes.select(*columns, seq, op), key, seq)
    if start != "INITIAL":
        return newest.filter(F.col(op) != "DELETE").select(*columns)
    values = [c for c in columns if c not in key]
    changed = newest.select(*key, F.struct(op, *values).alias("new"))
    joined = base.select(*key, F.struct(*values).alias("old")).join(changed, key, "full")
    alive = F.col("new").isNull() | (F.col(f"new.{op}") != "DELETE")
    pick = lambda c: F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    return joined.filter(alive).select(*key, *[pick(c).alias(c) for c in values]).select(*columns)


def reconcile_schema(df: DataFrame, target: DataFrame, policy: str) -> DataFrame:
    """Rows shaped for the target. EVOLVE keeps new columns, LENIENT leaves them out, EXCEPTION refuses them."""
    extra = [c for c in df.columns if c not in target.columns]
    if extra and policy == "EXCEPTION":
        raise ValueError("new columns: " + ", ".join(extra))
    if policy not in ("EVOLVE", "LENIENT", "EXCEPTION"):
        raise ValueError(f"unknown policy {policy}")
    shaped = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
              else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    return df.select(*shaped, *(extra if policy == "EVOLVE" else []))


def evolve(target: DataFrame, df: DataFrame) -> DataFrame:
    """Target and new rows together; columns either side lacks are null there."""
    return target.unionByName(df, allowMissingColumns=True)


def minute_metrics(samples: DataFrame, ts: str = "sampled_at", *more: Column) -> DataFrame:
    """One row per pipeline and minute: whole mean and maximum of valid lags, mean of valid throughputs, last counters.

    On a stream call ``withWatermark`` first; on a batch frame any timestamp type will do. ``more`` are further
    aggregates, appended under their names.
    """

    lag, rate = F.col("lag_seconds"), F.col("records_per_second")
    valid_lag = F.when(lag >= 0, lag)
    last = F.max_by(F.struct("restarts", "total_changes"), F.struct(ts, "total_changes"))
    grouped = samples.groupBy("pipeline_id", F.window(ts, "1 minute").alias("w")).agg(
        F.floor(F.sum(valid_lag) / F.count(valid_lag)).cast("int").alias("lag_avg_seconds"),
        F.max(valid_lag).cast("int").alias("lag_max_seconds"),
        F.avg(F.when(rate >= 0, rate)).alias("records_per_second_avg"), last.alias("last"), *more)
    extra = grouped.columns[len(grouped.columns) - len(more):]
    return grouped.select("pipeline_id", F.col("w.start").alias("minute_at"), "lag_avg_seconds", "lag_max_seconds",
                          "records_per_second_avg", F.col("last.restarts").alias("restarts"),
                          F.col("last.total_changes").alias("total_changes"), *extra)


def sessions(events: DataFrame, keys: Sequence[str], gap: str, ts: str, *aggregates: Column) -> DataFrame:
    """One row per session: the keys, its first moment, its end (the last moment plus ``gap``), rows, and ``aggregates``.

    Rows of a key belong together while each comes at most ``gap`` after one before it. Neighbouring rows of a task are
    merged ahead of the shuffle, so a busy key sends its sessions rather than its rows. On a stream call
    ``withWatermark`` first. Rows without a moment are in no session; those without a key are a key of their own.
    """
    grouped = events.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)
    return grouped.select(*keys, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"),
                          *[c for c in grouped.columns if c not in (*keys, "w")])


def metric_trend(minutes: DataFrame, name: str | None, as_of, pipeline_id: int | None = None) -> DataFrame:
    """Lag and throughput per bucket of a named range; buckets without samples stay out."""
    hours, bucket = TREND_RANGES.get(name or "24h", TREND_RANGES["24h"])
    rows = minutes.filter(half_open(F.col("minute_at"), ago(as_of, hours=hours), as_of))
    if pipeline_id is not None:
        rows = rows.filter(F.col("pipeline_id") == pipeline_id)
    width = bucket if bucket[0].isdigit() else f"1 {bucket}"
    return rows.groupBy("pipeline_id", F.window("minute_at", width).alias("w")).agg(
        F.avg("lag_avg_seconds").alias("lag_avg_seconds"), F.max("lag_max_seconds").alias("lag_max_seconds"),
        F.avg("records_per_second_avg").alias("records_per_second_avg")).select(
        "pipeline_id", F.col("w.start").alias("minute_at"), "lag_avg_seconds", "lag_max_seconds",
        "records_per_second_avg")


def sample_from_subtasks(metrics: DataFrame, keys: Sequence[str] = ("pipeline_id", "sampled_at")) -> DataFrame:
    """One sample per pipeline and poll from per-subtask metrics (vertex, records_out, records_per_second, lag_ms).

    Changes and throughput are sums over sink subtasks, -1 when any of them lacks the metric; the lag is the largest
    over source subtasks in whole seconds, -1 when none has one. A vertex may be source and sink at once.
    """
    sink, source = F.col("vertex").contains("Sink"), F.col("vertex").contains("Source")

    def total(col: str) -> Column:
        gaps = count_when(sink & F.col(col).isNull())
        return F.when(gaps > 0, -1).otherwise(F.coalesce(F.sum(F.when(sink, F.col(col))), F.lit(0)))

    lag = F.max(F.when(source & (F.col("lag_ms") >= 0), F.col("lag_ms")))
    return metrics.groupBy(*keys).agg(
        F.coalesce(F.floor(lag / 1000), F.lit(-1)).cast("bigint").alias("lag_seconds"),
        total("records_out").cast("bigint").alias("total_changes"),
        total("records_per_second").cast("double").alias("records_per_second"))


def lag_alerts(samples: DataFrame, threshold: int = LAG_WARN_SECONDS, ts: str = "sampled_at",
               order: str = "total_changes") -> DataFrame:
    """Samples at which the lag rises above the threshold; an alert re-arms once the lag is back or unknown."""
    late = F.col("lag_seconds") > threshold
    marked = previous_value(samples, ["pipeline_id"], ts, order, late, "was_late")
    return marked.filter(late & ~F.coalesce("was_late", F.lit(False))).drop("was_late")


def consecutive_misses(polls: DataFrame, missing: Column, n: int = NOT_FOUND_POLLS, ts: str = "sampled_at",
                       order: str = "total_changes", key: str = "pipeline_id") -> DataFrame:
    """Polls that complete ``n`` misses in a row and so count the job as stopped; the count then starts anew."""
    counted = streaks(polls, [key], ts, order, missing, "misses")
    return counted.filter((F.col("misses") > 0) & (F.col("misses") % n == 0))


def current_state(samples: DataFrame, ts: str = "sampled_at") -> DataFrame:
    """Last valid lag and change count per pipeline."""
    order = F.struct(ts, "total_changes")
    last = lambda c: F.max_by(c, F.when(F.col(c) >= 0, order)).alias(f"current_{c}")
    return samples.groupBy("pipeline_id").agg(last("lag_seconds"), last("total_changes"))


def subscription_metrics(events: DataFrame, as_of, ts: str = "ts") -> DataFrame:
    """Per pipeline: events and failed sends of the day, last event, and P95 over the last 1024 latencies.

    Counts per minute tell from which minute on the last samples lie. Only rows from there on are ranked, so a hot
    pipeline ranks little more than the sample itself.
    """
    midnight = F.date_trunc("day", ntz(as_of)).cast("timestamp_ntz")
    before = events.filter(F.col(ts) < ntz(as_of))
    sent = F.col("ok")
    counts = before.groupBy("pipeline_id").agg(
        count_when(sent & (F.col(ts) >= midnight)).alias("today_events"),
        count_when(~sent & (F.col(ts) >= midnight)).alias("failed_sends"),
        F.max(F.when(sent, F.col(ts))).alias("last_event_at"))
    by_pipeline = Window.partitionBy("pipeline_id")
    minute = F.date_trunc("minute", F.col(ts)).cast("timestamp_ntz")
    sample = before.filter(sent).select("pipeline_id", ts, "id", F.greatest("latency_ms", F.lit(0)).alias("latency_ms"))
    minutes = sample.groupBy("pipeline_id", minute.alias("minute")).agg(F.count("*").alias("n"))
    later = F.sum("n").over(by_pipeline.orderBy(F.desc("minute"))) - F.col("n")  # one row per minute
    since = minutes.withColumn("later", later).filter(F.col("later") < LATENCY_SAMPLES).groupBy("pipeline_id").agg(
        F.min("minute").alias("since"))
    recent = sample.join(since, "pipeline_id").filter(F.col(ts) >= F.col("since")).drop("since")
    sample = top_per_key(recent, ["pipeline_id"], [F.desc(ts), F.desc("id")], "id", LATENCY_SAMPLES)
    p95 = sample.groupBy("pipeline_id").agg(
        F.expr(f"percentile_disc({LATENCY_SHARE}) WITHIN GROUP (ORDER BY latency_ms)").cast("bigint").alias("p95_ms"))
    return counts.join(p95, "pipeline_id", "left").select(
        "pipeline_id", "today_events", "failed_sends", F.coalesce("p95_ms", F.lit(0)).alias("p95_ms"), "last_event_at")


def subscriber_counts(events: DataFrame, as_of, ts: str = "ts") -> DataFrame:
    """Events received today and last event per pipeline and subscriber key."""
    midnight = F.date_trunc("day", ntz(as_of)).cast("timestamp_ntz")
    return events.filter((F.col(ts) < ntz(as_of)) & F.col("ok")).groupBy("pipeline_id", "key_id").agg(
        count_when(F.col(ts) >= midnight).alias("received_today"), F.max(ts).alias("last_event_at"))


def route_events(events: DataFrame, grants: DataFrame) -> DataFrame:
    """One row per event and subscriber granted its pipeline; events without a subscriber are dropped."""
    return events.join(grants.select("pipeline_id", "key_id").distinct(), "pipeline_id")


def route_tables(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events with their sink table; tables outside the mapping are dropped."""
    return events.join(mapping.select(F.col("source_table").alias("table"), "sink_table").distinct(), "table")
