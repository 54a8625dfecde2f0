"""Change events and stream metrics, as batch frames and as drained streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brightwell.operators import cdc as ops
from brightwell.plans.lineage_cut import ensure_checkpoint_dir
from brightwell.streaming import flows, sinks, stateful
from registry.base import Registry, shown
from registry.replays import R as REPLAYS
from registry.views import EVENT_CLOCK, StreamLake

R = Registry()
#: The bundled samples are hours apart, so slices of event time are days here.
DAY = 86_400

EVENT = """
e AS (SELECT seq, topic, kafka_ts, CASE value->>'$.op' WHEN 'c' THEN 'INSERT' WHEN 'u' THEN 'UPDATE' WHEN 'd' THEN 'DELETE' END AS op_type,
  value->>'$.source.table' AS "table", CAST(COALESCE(value->>'$.after.user_id', value->>'$.before.user_id') AS BIGINT) AS user_id,
  CAST(value->>'$.after.cents' AS BIGINT) AS cents, COALESCE(CAST(value->>'$.ts_ms' AS BIGINT), epoch_us(kafka_ts) // 1000) AS event_ms
  FROM cdc_raw),
n AS (SELECT *, GREATEST(epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - event_ms, 0) AS latency_ms FROM e WHERE op_type IS NOT NULL)"""


def _events(lake):
    events = ops.normalize_cdc(lake("cdc_raw"), EVENT_CLOCK)
    data = F.col("data")
    return events.withColumns({"user_id": data["user_id"].cast("bigint"), "cents": data["cents"].cast("bigint")}).drop("data")


def _scratch(lake, name):
    """A fresh folder below the shared checkpoint folder for a drained stream."""
    base = f"{ensure_checkpoint_dir(lake.spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/checkpoint"


def _in_batches(lake, name, rows, ts, build, parts=4):
    """``build`` over a stream of ``rows``, fed in ``parts`` slices of time and drained after each with one checkpoint.

    So the stream is stopped and taken up again between its batches. A last row far ahead, without a key, moves the
    watermark past everything.
    """
    source, (path, checkpoint) = _scratch(lake, f"{name}-source")[0], _scratch(lake, name)
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(moment, [k / parts for k in range(1, parts)]).alias("cuts"), F.max(ts).alias("last")).first()
    edges = [None, *(cuts["cuts"] or []), None]
    closing = lake.spark.range(1).select(*[
        (F.lit(cuts["last"]).cast(f.dataType) + F.expr("INTERVAL 400 DAYS") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in rows.schema.fields])
    slices = [rows.filter((F.lit(low is None) | (moment > low)) & (F.lit(high is None) | (moment <= high)))
              for low, high in zip(edges, edges[1:])]
    result = None
    for part in (*slices, closing):
        part.write.mode("append").parquet(source)
        if result is None:
            result = build(lake.spark.readStream.schema(rows.schema).parquet(source))
        flows.append_to(result, checkpoint, path).awaitTermination()
    return lake.spark.read.schema(result.schema).parquet(path)


def _drained(lake, name, df):
    path, checkpoint = _scratch(lake, name)
    flows.append_to(df, checkpoint, path).awaitTermination()
    return lake.spark.read.schema(df.schema).parquet(path)


@R.query("f1_normalized_events", f"WITH {EVENT.strip()} SELECT * FROM n")
def _(lake):
    return _events(lake)


@R.query("f1_normalized_events_streamed", f"WITH {EVENT.strip()} SELECT * FROM n")
def _(lake):
    return _drained(lake, "events", _events(StreamLake(lake.spark, lake.folder)))


@R.query("f2_change_stream_of_topic", f"""WITH {EVENT.strip()} SELECT seq, topic, CAST(substr(topic, 12) AS BIGINT) AS pipeline_id FROM n
WHERE topic LIKE 'cdc-events-%'""")
def _(lake):
    return ops.with_pipeline(_events(lake)).select("seq", "topic", "pipeline_id")


CURRENT = f"""WITH {EVENT.strip()}, l AS (SELECT DISTINCT ON (user_id) user_id, cents, op_type FROM n ORDER BY user_id, seq DESC)"""


@R.query("f3_current_rows", f"""{CURRENT}
SELECT user_id, cents FROM cdc_base WHERE user_id NOT IN (SELECT user_id FROM l)
UNION ALL SELECT user_id, cents FROM l WHERE op_type <> 'DELETE'""")
def _(lake):
    return ops.apply_changes(lake("cdc_base"), _events(lake), ["user_id"], "seq")


@R.query("f3_current_rows_without_snapshot", f"{CURRENT} SELECT user_id, cents FROM l WHERE op_type <> 'DELETE'")
def _(lake):
    return ops.apply_changes(lake("cdc_base"), _events(lake), ["user_id"], "seq", start="EARLIEST")


@R.query("f3_current_rows_streamed", f"{CURRENT} SELECT user_id, cents FROM l WHERE op_type <> 'DELETE'")
def _(lake):
    path, checkpoint = _scratch(lake, "rows")
    changes = _events(StreamLake(lake.spark, lake.folder)).select("user_id", "cents", "seq", "op_type")
    flows.apply_change_stream(changes, path, checkpoint, "seq").awaitTermination()
    return sinks.read_current(lake.spark, path, ["user_id"], ["seq"], "seq", "part")


@R.query("f3_current_rows_from_base_and_tail", f"{CURRENT} SELECT user_id, cents FROM l WHERE op_type <> 'DELETE'")
def _(lake):
    """The log is compacted between two halves of the stream; the read takes the base and what came after it."""
    path, checkpoint = _scratch(lake, "based")
    events = _events(lake).select("user_id", "cents", "seq", "op_type")
    source = _scratch(lake, "based-source")[0]
    half = events.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for early in (True, False):
        events.filter(F.col("seq") <= half if early else F.col("seq") > half).write.mode("append").parquet(source)
        stream = lake.spark.readStream.schema(events.schema).parquet(source)
        flows.apply_change_stream(stream, path, checkpoint, "seq").awaitTermination()
        if early:
            sinks.compact(lake.spark, path, ["user_id"], ["seq"])
    return sinks.read_current(lake.spark, path, ["user_id"], ["seq"], "seq", "part")


@R.query("f4_evolved_schema", """
SELECT user_id, cents, CAST(NULL AS VARCHAR) AS op_type FROM cdc_base
UNION ALL SELECT user_id, CAST(FLOOR(value * 100) AS BIGINT), event_type FROM events""")
def _(lake):
    fresh = lake("events").select("user_id", F.floor(F.col("value") * 100).alias("cents"), F.col("event_type").alias("op_type"))
    return ops.evolve(lake("cdc_base"), ops.reconcile_schema(fresh, lake("cdc_base"), "EVOLVE"))


@R.query("f4_lenient_schema", "SELECT user_id, CAST(NULL AS BIGINT) AS cents FROM events")
def _(lake):
    return ops.reconcile_schema(lake("events"), lake("cdc_base"), "LENIENT")


MINUTES = """minutes AS (SELECT pipeline_id, date_trunc('minute', sampled_at)::TIMESTAMP AS minute_at,
  CAST(FLOOR(AVG(lag_seconds) FILTER (WHERE lag_seconds >= 0)) AS INT) AS lag_avg_seconds,
  CAST(MAX(lag_seconds) FILTER (WHERE lag_seconds >= 0) AS INT) AS lag_max_seconds,
  AVG(records_per_second) FILTER (WHERE records_per_second >= 0) AS records_per_second_avg,
  ARG_MAX(restarts, {'a': sampled_at, 'b': total_changes}) AS restarts,
  ARG_MAX(total_changes, {'a': sampled_at, 'b': total_changes}) AS total_changes FROM metric_sample GROUP BY 1, 2)"""


@R.query("f5_minute_metrics", f"WITH {MINUTES} SELECT * FROM minutes")
def _(lake):
    return ops.minute_metrics(lake("metric_sample"))


@R.query("f6_minute_metrics_streamed_upsert", f"WITH {MINUTES} SELECT * FROM minutes")
def _(lake):
    path, checkpoint = _scratch(lake, "minutes")
    flows.minute_metric_stream(StreamLake(lake.spark, lake.folder)("metric_sample"), path, checkpoint).awaitTermination()
    return shown(sinks.read_current(lake.spark, path, ["pipeline_id", "minute_at"], flows.METRIC_SEQUENCE, "day",
                                    *flows.METRIC_SEQUENCE))


def _trend(bucket, first):
    return f"""WITH {MINUTES} SELECT pipeline_id, {bucket} AS minute_at, ROUND(AVG(lag_avg_seconds), 6) AS lag_avg_seconds,
  MAX(lag_max_seconds) AS lag_max_seconds, ROUND(AVG(records_per_second_avg), 6) AS records_per_second_avg
FROM minutes WHERE minute_at >= TIMESTAMP '{first}' AND minute_at < TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1, 2"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("lag_avg_seconds", "records_per_second_avg")})


@R.query("f7_trend_by_hour", _trend("date_trunc('hour', minute_at)::TIMESTAMP", "2024-01-23 00:00:00"))
def _(lake):
    return _rounded(ops.metric_trend(ops.minute_metrics(lake("metric_sample")), "7d", "2024-01-30"))


@R.query("f7_trend_by_five_minutes", _trend("time_bucket(INTERVAL 5 MINUTE, minute_at)", "2024-01-29 00:00:00"))
def _(lake):
    return _rounded(ops.metric_trend(ops.minute_metrics(lake("metric_sample")), None, "2024-01-30"))


@R.query("f7_trend_by_minute", _trend("minute_at", "2024-01-29 18:00:00"))
def _(lake):
    return _rounded(ops.metric_trend(ops.minute_metrics(lake("metric_sample")), "6h", "2024-01-30"))


@R.query("f8_samples_from_subtasks", """
SELECT pipeline_id, sampled_at, COALESCE(MAX(lag_ms) FILTER (WHERE vertex LIKE '%Source%' AND lag_ms >= 0) // 1000, -1) AS lag_seconds,
  CAST(CASE WHEN COUNT(*) FILTER (WHERE vertex LIKE '%Sink%' AND records_out IS NULL) > 0 THEN -1
    ELSE COALESCE(SUM(records_out) FILTER (WHERE vertex LIKE '%Sink%'), 0) END AS BIGINT) AS total_changes,
  CAST(CASE WHEN COUNT(*) FILTER (WHERE vertex LIKE '%Sink%' AND records_per_second IS NULL) > 0 THEN -1
    ELSE COALESCE(SUM(records_per_second) FILTER (WHERE vertex LIKE '%Sink%'), 0) END AS DOUBLE) AS records_per_second
FROM subtask_metric GROUP BY 1, 2""")
def _(lake):
    return ops.sample_from_subtasks(lake("subtask_metric"))


SAMPLE = "pipeline_id, sampled_at, lag_seconds, records_per_second, restarts, total_changes"
LAG = f"""SELECT {SAMPLE} FROM (SELECT *, lag_seconds > 250 AS late, COALESCE(LAG(lag_seconds > 250) OVER (PARTITION BY pipeline_id
  ORDER BY sampled_at, total_changes), FALSE) AS was FROM metric_sample) x WHERE late AND NOT was"""


@R.query("f9_lag_alerts", LAG)
def _(lake):
    return ops.lag_alerts(lake("metric_sample"), threshold=250)


@R.query("f9_lag_alerts_streamed", LAG)
def _(lake):
    return _in_batches(lake, "alerts", lake("metric_sample"), "sampled_at",
                       lambda s: stateful.lag_alert_stream(s, 250, slice_s=DAY, forget_s=40 * DAY))


MISSES = f"""SELECT {SAMPLE}, misses FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pipeline_id, spell, missing
  ORDER BY sampled_at, total_changes) AS misses FROM (SELECT *, lag_seconds < 0 AS missing, COUNT(*) FILTER (WHERE lag_seconds >= 0)
  OVER (PARTITION BY pipeline_id ORDER BY sampled_at, total_changes ROWS UNBOUNDED PRECEDING) AS spell FROM metric_sample) x) y
WHERE missing AND misses % 3 = 0"""


@R.query("f10_consecutive_misses", MISSES)
def _(lake):
    return ops.consecutive_misses(lake("metric_sample"), F.col("lag_seconds") < 0)


@R.query("f10_consecutive_misses_streamed", MISSES)
def _(lake):
    polls = lake("metric_sample").withColumn("is_missing", F.col("lag_seconds") < 0)
    return _in_batches(lake, "misses", polls, "sampled_at",
                       lambda s: stateful.miss_stream(s, slice_s=DAY, forget_s=40 * DAY)).drop("is_missing")


@R.query("f11_subscription_metrics", """
WITH p AS (SELECT * FROM push_event WHERE ts < TIMESTAMP '2024-01-29 20:00:00'),
s AS (SELECT pipeline_id, GREATEST(latency_ms, 0) AS latency_ms FROM p WHERE ok QUALIFY ROW_NUMBER() OVER (PARTITION BY pipeline_id
  ORDER BY ts DESC, id DESC) <= 1024),
q AS (SELECT pipeline_id, latency_ms, ROW_NUMBER() OVER (PARTITION BY pipeline_id ORDER BY latency_ms) AS k,
  COUNT(*) OVER (PARTITION BY pipeline_id) AS n FROM s)
SELECT p.pipeline_id, COUNT(*) FILTER (WHERE ok AND ts >= TIMESTAMP '2024-01-29 00:00:00') AS today_events,
  COUNT(*) FILTER (WHERE NOT ok AND ts >= TIMESTAMP '2024-01-29 00:00:00') AS failed_sends,
  COALESCE((SELECT MIN(latency_ms) FROM q WHERE q.pipeline_id = p.pipeline_id AND k = CAST(CEIL(n * 0.95) AS BIGINT)), 0) AS p95_ms,
  MAX(ts) FILTER (WHERE ok) AS last_event_at FROM p GROUP BY p.pipeline_id""")
def _(lake):
    return ops.subscription_metrics(lake("push_event"), "2024-01-29 20:00:00")


@R.query("f11_subscriber_counts", """
SELECT pipeline_id, key_id, COUNT(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29 00:00:00') AS received_today, MAX(ts) AS last_event_at
FROM push_event WHERE ok AND ts < TIMESTAMP '2024-01-29 20:00:00' GROUP BY 1, 2""")
def _(lake):
    return ops.subscriber_counts(lake("push_event"), "2024-01-29 20:00:00")


ROUTED = f"""WITH {EVENT.strip()} SELECT seq, op_type, pipeline_id, key_id FROM (SELECT *, CAST(substr(topic, 12) AS BIGINT) AS p FROM n) m
JOIN (SELECT DISTINCT pipeline_id, key_id FROM subscription) s ON s.pipeline_id = m.p"""


@R.query("f12_routed_events", ROUTED)
def _(lake):
    return ops.route_events(ops.with_pipeline(_events(lake)), lake("subscription")).select(
        "seq", "op_type", "pipeline_id", "key_id")


@R.query("f12_routed_events_streamed", ROUTED)
def _(lake):
    events = ops.with_pipeline(_events(StreamLake(lake.spark, lake.folder)))
    return _drained(lake, "routed", ops.route_events(events, lake("subscription")).select(
        "seq", "op_type", "pipeline_id", "key_id"))


@R.query("f13_current_state", """
SELECT pipeline_id, ARG_MAX(lag_seconds, {'a': sampled_at, 'b': total_changes}) FILTER (WHERE lag_seconds >= 0) AS current_lag_seconds,
  ARG_MAX(total_changes, {'a': sampled_at, 'b': total_changes}) FILTER (WHERE total_changes >= 0) AS current_total_changes
FROM metric_sample GROUP BY 1""")
def _(lake):
    return ops.current_state(lake("metric_sample"))


@R.query("f14_windowed_calls_streamed", """
SELECT date_trunc('hour', created_at)::TIMESTAMP AS hour_at, api_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE status_code >= 400) AS failed
FROM call_log GROUP BY 1, 2""")
def _(lake):
    """Event-time windows with a watermark; counts of open windows are upserted as they grow."""
    path, checkpoint = _scratch(lake, "hours")
    calls = StreamLake(lake.spark, lake.folder)("call_log").withColumn("created_at", F.col("created_at").cast("timestamp"))
    hours = calls.withWatermark("created_at", "1 hour").groupBy("api_id", F.window("created_at", "1 hour").alias("w")).agg(
        F.count("*").alias("total"), F.count_if(F.col("status_code") >= 400).alias("failed")).select(
        F.col("w.start").alias("hour_at"), "api_id", "total", "failed")

    def add(batch, _):
        sinks.append_batch(batch.withColumn("day", F.to_date("hour_at")), path, "day")

    flows.start(hours, checkpoint, add, "update").awaitTermination()
    return shown(sinks.read_current(lake.spark, path, ["api_id", "hour_at"], ["total"], "day"))


SESSIONS = """
SELECT api_id, MIN(created_at) AS started_at, MAX(created_at) + INTERVAL 2 HOUR AS ended_at, COUNT(*) AS n_rows,
  COUNT(*) FILTER (WHERE status_code >= 400) AS failed, MAX(duration_ms) AS slowest_ms FROM (
  SELECT *, COUNT(*) FILTER (WHERE fresh) OVER (PARTITION BY api_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS session
  FROM (SELECT *, COALESCE(created_at > LAG(created_at) OVER (PARTITION BY api_id ORDER BY created_at, id) + INTERVAL 2 HOUR, TRUE)
    AS fresh FROM call_log) x) y GROUP BY api_id, session"""


def _of_session():
    return F.count_if(F.col("status_code") >= 400).alias("failed"), F.max("duration_ms").alias("slowest_ms")


@R.query("f14_sessions", SESSIONS)
def _(lake):
    return ops.sessions(lake("call_log"), ["api_id"], "2 hours", "created_at", *_of_session())


@R.query("f14_sessions_streamed", SESSIONS)
def _(lake):
    """Sessions that span several micro-batches are merged in the state store."""
    return shown(_in_batches(lake, "sessions", lake("call_log"), "created_at",
                             lambda s: flows.session_stream(s, ["api_id"], "2 hours", "created_at", *_of_session())))


@R.query("a12_lake_sink_streamed", f"""WITH {EVENT.strip()} SELECT seq, op_type, "table", user_id, cents, sink_table FROM n
JOIN cdc_route r ON r.source_table = n."table\"""")
def _(lake):
    path, checkpoint = _scratch(lake, "lake")
    events = _events(StreamLake(lake.spark, lake.folder)).select("seq", "op_type", "table", "user_id", "cents")
    flows.lake_sink(events, lake("cdc_route"), path, checkpoint).awaitTermination()
    return lake.spark.read.parquet(path)


@R.query("h11_daily_view_counts_streamed", "SELECT table_id, CAST(view_date AS VARCHAR) AS view_date, view_count FROM asset_view")
def _(lake):
    path, checkpoint = _scratch(lake, "views")
    flows.view_count_stream(StreamLake(lake.spark, lake.folder)("asset_view_event"), path, checkpoint).awaitTermination()
    return shown(sinks.read_current(lake.spark, path, ["table_id", "view_date"], ["view_count"], "day"))


def _sql(name):
    return REPLAYS.items[name].sql


for _name, _ts, _rows, _build in [
    ("c17_rate_limit_replay", "created_at", lambda lake: lake("call_log").select("id", "key_id", "created_at"),
     lambda stream, lake: stateful.rate_limit_stream(stream, lake("key_limit"), 172_800, slice_s=DAY)),
    ("c18_circuit_replay", "created_at", lambda lake: lake("call_log").select(
        "id", "api_id", "created_at", (F.col("status_code") >= 500).alias("failed")),
     lambda stream, lake: stateful.circuit_stream(stream, "api_id", wait_s=14_400, slice_s=DAY, forget_s=400 * DAY)),
    ("c31_deduplicated_alerts", "fired_at", lambda lake: lake("alert_candidate"),
     lambda stream, lake: stateful.dedupe_stream(stream, window_s=21_600, slice_s=DAY)),
]:
    def _streamed(lake, name=_name, ts=_ts, rows=_rows, build=_build):
        return _in_batches(lake, name, rows(lake), ts, lambda stream: build(stream, lake))

    R.query(f"{_name}_streamed")(_streamed)
    # The batch replay's check SQL already carries its views.
    R.items[f"{_name}_streamed"] = type(R.items[f"{_name}_streamed"])(f"{_name}_streamed", _streamed, _sql(_name))
