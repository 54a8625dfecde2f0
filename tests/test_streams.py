"""Streams fed in several files, one per micro-batch, against the batch form; skewed keys in forced chunks."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brightwell.operators import cdc, replay
from brightwell.plans.two_level import previous_value, streaks
from brightwell.streaming import flows, sinks, stateful

START = datetime(2024, 1, 1)
SAMPLE = "pipeline_id bigint, sampled_at timestamp_ntz, lag_seconds bigint, records_per_second bigint, restarts int, total_changes bigint"


def samples(n=500, seed=3):
    rng = random.Random(seed)
    moments = sorted(rng.randrange(7200) for _ in range(n))
    return [(0 if rng.random() < 0.5 else rng.randrange(1, 4), START + timedelta(seconds=s), rng.choice([-1, 5, 20, 40, 90]),
             rng.choice([-1, 10, 20]), rng.randrange(3), i) for i, s in enumerate(moments)]


@pytest.fixture(scope="module")
def sample_rows(spark):
    return spark.createDataFrame(samples(), SAMPLE)


def in_files(spark, df, order, path, parts=5):
    """Writes the rows in order as ``parts`` files and returns a stream that takes one file per batch."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def close_stream(spark, schema, ts, path, at=START + timedelta(days=400)):
    """One more file with a row far ahead, which moves the watermark past all others."""
    names = spark.createDataFrame([], schema).columns
    spark.createDataFrame([tuple(at if n == ts else None for n in names)], schema).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def drained(spark, df, folder):
    flows.append_to(df, f"{folder}/check", f"{folder}/out").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("seconds", [None, 300, 30])
def test_two_level_windows_equal_plain_windows(sample_rows, seconds):
    late = F.col("lag_seconds") > 30
    plain = previous_value(sample_rows, ["pipeline_id"], "sampled_at", "total_changes", late, "was", seconds=100_000_000)
    assert rows_of(previous_value(sample_rows, ["pipeline_id"], "sampled_at", "total_changes", late, "was", seconds)) == rows_of(plain)
    missing = F.col("lag_seconds") < 30
    whole = streaks(sample_rows, ["pipeline_id"], "sampled_at", "total_changes", missing, "n", seconds=100_000_000)
    assert rows_of(streaks(sample_rows, ["pipeline_id"], "sampled_at", "total_changes", missing, "n", seconds)) == rows_of(whole)


def test_hot_key_is_chunked_and_others_are_not(sample_rows):
    late = F.col("lag_seconds") > 30
    mixed = previous_value(sample_rows, ["pipeline_id"], "sampled_at", "total_changes", late, "was", target_rows=100)
    plain = previous_value(sample_rows, ["pipeline_id"], "sampled_at", "total_changes", late, "was")
    assert rows_of(mixed) == rows_of(plain)


def test_lag_alerts_and_misses_stream(spark, sample_rows, folder):
    stream = in_files(spark, sample_rows, "total_changes", f"{folder}/in")
    close_stream(spark, SAMPLE, "sampled_at", f"{folder}/in")
    assert rows_of(drained(spark, stateful.lag_alert_stream(stream), f"{folder}/a")) == rows_of(cdc.lag_alerts(sample_rows))
    missing = F.col("lag_seconds") < 0
    streamed = stateful.miss_stream(stream.withColumn("is_missing", missing), slice_s=600).drop("is_missing")
    assert rows_of(drained(spark, streamed, f"{folder}/b")) == rows_of(cdc.consecutive_misses(sample_rows, missing))


def test_rows_out_of_order_within_the_watermark(spark, sample_rows, folder):
    rng = random.Random(2)
    mixed = [(*r, r[1].timestamp() + rng.random() * 500) for r in map(tuple, sample_rows.collect())]
    shuffled = spark.createDataFrame(mixed, SAMPLE + ", arrival double")
    stream = in_files(spark, shuffled, "arrival", f"{folder}/in", 6)
    close_stream(spark, SAMPLE + ", arrival double", "sampled_at", f"{folder}/in")
    got = drained(spark, stateful.lag_alert_stream(stream.drop("arrival"), watermark="10 minutes"), f"{folder}/a")
    assert rows_of(got) == rows_of(cdc.lag_alerts(sample_rows))


def stored(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/check")


def test_state_goes_away(spark, folder):
    late = lambda key, minute, lag: (key, START + timedelta(minutes=minute), lag, 1, 0, minute)
    files = [[late(1, 0, 90), late(2, 0, 5), late(3, 0, 90)], [late(1, 10, 90), late(3, 10, 5), late(2, 10, 5)], [late(2, 11, 5)],
             [late(2, 300, 5)], [late(1, 301, 90), late(2, 320, 5)], [late(2, 400, 5)]]
    fired, kept = [], []
    for rows in files:
        spark.createDataFrame(rows, SAMPLE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SAMPLE).parquet(f"{folder}/in")
        got = drained(spark, stateful.lag_alert_stream(stream, forget_s=3600), folder)
        fired.append(sorted((r.pipeline_id, r.total_changes) for r in got.collect()))
        kept.append(sorted(r.key.pipeline_id for r in stored(spark, folder, "carried").collect()))
    # Pipeline 3 is back in time and leaves nothing; 1 is forgotten after an hour of silence and fires anew.
    assert fired[2] == [(1, 0), (3, 0)] and fired[-1] == [(1, 0), (1, 301), (3, 0)]
    assert kept[0] == [] and kept[2] == ["1"] and kept[3] == []
    waiting = {r.key.pipeline_id for r in stored(spark, folder, "pending").collect()}
    assert waiting == {"2"}  # the last sample waits for its slice to end


def test_late_rows_are_dropped_by_the_scan(spark, folder):
    first = [(1, START + timedelta(minutes=m), 90, 1, 0, m) for m in range(0, 60, 10)]
    for rows in (first, [(1, START + timedelta(minutes=5), 5, 1, 0, 100)]):
        spark.createDataFrame(rows, SAMPLE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SAMPLE).parquet(f"{folder}/in")
        query = flows.append_to(stateful.lag_alert_stream(stream), f"{folder}/check", f"{folder}/out")
        query.awaitTermination()
    assert flows.dropped_late(query) == 1
    assert spark.read.parquet(f"{folder}/out").count() == 1


def test_one_key_with_many_rows_is_scanned_by_slices(spark, folder, monkeypatch):
    rows = spark.range(30_000).selectExpr(
        "CAST(NULL AS BIGINT) AS pipeline_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id / 4) AS sampled_at",
        "CAST(pmod(hash(id), 60) AS BIGINT) AS lag_seconds", "1L AS records_per_second", "0 AS restarts", "id AS total_changes")
    stream = in_files(spark, rows, "total_changes", f"{folder}/in", 4)
    close_stream(spark, SAMPLE, "sampled_at", f"{folder}/in")
    got = drained(spark, stateful.lag_alert_stream(stream, slice_s=300), f"{folder}/a")
    assert rows_of(got) == rows_of(cdc.lag_alerts(rows))


def test_sessions_over_batches(spark, folder):
    rng = random.Random(4)
    rows = [(rng.randrange(3), START + timedelta(seconds=rng.randrange(0, 20_000)), k) for k in range(150)]
    rows += [(9, START, 900), (9, START + timedelta(minutes=5), 901), (9, START + timedelta(minutes=10, seconds=1), 902), (None, START, 903)]
    events = spark.createDataFrame(rows, "key bigint, at timestamp_ntz, id bigint")
    expected = rows_of(cdc.sessions(events, ["key"], "5 minutes", "at", F.sum("id").alias("total")))
    stream = in_files(spark, events, "id", f"{folder}/in", 5)
    close_stream(spark, "key bigint, at timestamp_ntz, id bigint", "at", f"{folder}/in")
    got = drained(spark, flows.session_stream(stream, ["key"], "5 minutes", "at", F.sum("id").alias("total"), watermark="1 day"), folder)
    assert rows_of(got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})) == expected
    at_gap = cdc.sessions(events.filter("key = 9"), ["key"], "5 minutes", "at").collect()
    assert sorted(r.n_rows for r in at_gap) == [1, 2]  # a row exactly a gap later still belongs


def test_late_rows_do_not_reach_sessions(spark, folder):
    schema = "key bigint, at timestamp_ntz"
    for rows in ([(1, START), (1, START + timedelta(hours=2))], [(1, START + timedelta(minutes=1)), (1, START + timedelta(hours=2, minutes=1))],
                 [(1, START + timedelta(days=9))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = flows.append_to(flows.session_stream(stream, ["key"], "5 minutes", "at"), f"{folder}/check", f"{folder}/out")
        query.awaitTermination()
        if len(rows) == 2 and rows[0][1] > START:
            assert flows.dropped_late(query) == 1
    assert sorted(r.n_rows for r in spark.read.parquet(f"{folder}/out").collect()) == [1, 2]


def read_minutes(spark, folder):
    return sinks.read_current(spark, f"{folder}/out", ["pipeline_id", "minute_at"], flows.METRIC_SEQUENCE, "day",
                              *flows.METRIC_SEQUENCE)


def test_minute_metrics_stream_over_batches(spark, sample_rows, folder):
    stream = in_files(spark, sample_rows, "total_changes", f"{folder}/in")
    flows.minute_metric_stream(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    got = read_minutes(spark, folder)
    got = got.withColumn("minute_at", F.col("minute_at").cast("timestamp_ntz"))
    assert rows_of(got) == rows_of(cdc.minute_metrics(sample_rows))


def test_rate_limit_and_dedupe_streams(spark, folder):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 2, 3]), START + timedelta(seconds=i * 2)) for i in range(300)]
    log = spark.createDataFrame(rows, "id bigint, key_id bigint, created_at timestamp_ntz")
    limits = spark.createDataFrame([(1, 4), (2, 1), (3, 0)], "key_id bigint, qps_limit int")
    stream = in_files(spark, log, "id", f"{folder}/in")
    close_stream(spark, log.schema, "created_at", f"{folder}/in")
    batch = replay.rate_limit_replay(log, limits)
    assert rows_of(drained(spark, stateful.rate_limit_stream(stream, limits), f"{folder}/a")) == rows_of(batch)
    alerts = lambda df: df.select("id", F.lit("DAG").alias("object_type"), F.col("key_id").alias("object_id"),
                                  F.lit("FAILURE").alias("alert_type"), F.col("created_at").alias("fired_at"))
    assert rows_of(drained(spark, stateful.dedupe_stream(alerts(stream)), f"{folder}/b")) == rows_of(
        replay.dedupe_alerts(alerts(log)))


def test_state_is_kept_by_buckets_of_keys(spark, folder):
    rng = random.Random(8)
    keys = [None, *range(40)]
    rows = [(i, rng.choice(keys), START + timedelta(seconds=i, microseconds=rng.randrange(1000))) for i in range(1200)]
    log = spark.createDataFrame(rows, "id bigint, key_id bigint, created_at timestamp_ntz")
    limits = spark.createDataFrame([(k, k % 3) for k in range(40)], "key_id bigint, qps_limit int")
    stream = in_files(spark, log, "id", f"{folder}/in", 2)
    got = drained(spark, stateful.rate_limit_stream(stream, limits, 300, buckets=4), f"{folder}/a")
    # 41 keys wait in four buckets, each with one part of rows in a slice and file.
    parts = stored(spark, f"{folder}/a", "pending")
    assert {r.key.scan_bucket for r in parts.select("key").distinct().collect()} <= {0, 1, 2, 3} and parts.count() <= 4 * 4
    assert stored(spark, f"{folder}/a", "carried").count() <= 4
    close_stream(spark, log.schema, "created_at", f"{folder}/in")
    got = drained(spark, stateful.rate_limit_stream(stream, limits, 300, buckets=4), f"{folder}/a")
    assert rows_of(got) == rows_of(replay.rate_limit_replay(log, limits, 300))


def test_a_silent_key_of_a_bucket_is_forgotten(spark, folder):
    rows = [(1, START), (2, START), (2, START + timedelta(minutes=50)), (1, START + timedelta(minutes=200)), (3, START + timedelta(minutes=300))]
    kept = []
    for k, row in enumerate(rows):
        log = spark.createDataFrame([(k, *row, True)], "id bigint, api_id bigint, created_at timestamp_ntz, failed boolean")
        log.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{folder}/in")
        drained(spark, stateful.circuit_stream(stream, "api_id", buckets=1, forget_s=3600), folder)
        states = [json.loads(r.value.state) for r in stored(spark, folder, "carried").collect()]
        kept.append([sorted(json.loads(name)["api_id"] for name in held) for held in states])
    # Key 1 was silent for over an hour when 2 was answered; 2 goes with its own timer in the next batch.
    assert kept == [[], [], [["1", "2"]], [["2"]], [["1"]]]


def test_moments_keep_their_type_and_microseconds(spark, folder):
    rows = spark.createDataFrame([(1, datetime(2024, 3, 10, 2, 30, 0, 7), 90, 1, 0, 1), (1, datetime(1999, 12, 31, 23, 59, 59, 999_999), 90, 1, 0, 0)], SAMPLE)
    for kind in ("timestamp_ntz", "timestamp"):
        typed = rows.withColumn("sampled_at", F.col("sampled_at").cast(kind))
        typed.coalesce(1).write.parquet(f"{folder}/{kind}")
        close_stream(spark, typed.schema, "sampled_at", f"{folder}/{kind}")
        stream = spark.readStream.schema(typed.schema).parquet(f"{folder}/{kind}")
        got = drained(spark, stateful.lag_alert_stream(stream, forget_s=3_000_000_000), f"{folder}/out-{kind}")
        assert got.schema["sampled_at"].dataType.simpleString() == kind
        assert rows_of(got) == rows_of(typed.filter("total_changes = 0"))


def test_parts_of_a_slice_are_numbered_once_per_batch():
    """Counts are read and written once per slice, however many frames a group comes in."""
    calls = []

    class Parts(dict):
        def containsKey(self, key):
            calls.append("has")
            return key in self

        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            calls.append("put")
            self[key] = value

    scan = stateful.OrderedScan(None, "id", ["id"], 1000, 1000)
    scan.handle = type("Handle", (), {"registerTimer": lambda self, at: calls.append("timer")})()
    scan.parts, scan.pending = Parts(), Parts()
    frame = pd.DataFrame({"id": [1, 2], "at_us": [0, 2_000_000], "event_time": [START, START]})
    scan.handleInputRows((1,), [frame] * 5, None)
    assert sorted(scan.pending) == [(s, n) for s in (0, 2) for n in range(5)] and dict(scan.parts) == {(0,): (5,), (2,): (5,)}
    assert (calls.count("has"), calls.count("put"), calls.count("timer")) == (2, 12, 2)


def test_change_stream_over_batches_and_replayed_batch(spark, folder):
    rng = random.Random(9)
    rows = [(rng.randrange(20), rng.randrange(1000), i, rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])) for i in range(400)]
    changes = spark.createDataFrame(rows, "id bigint, amount bigint, seq bigint, op_type string")
    stream = in_files(spark, changes, "seq", f"{folder}/in")
    flows.apply_change_stream(stream, f"{folder}/out", f"{folder}/check", "seq").awaitTermination()
    expected = cdc.apply_changes(changes.select("id", "amount").limit(0), changes, ["id"], "seq")
    current = lambda: rows_of(sinks.read_current(spark, f"{folder}/out", ["id"], ["seq"], "seq", "part"))
    assert current() == rows_of(expected)
    # A new checkpoint reads everything again; rows go by their own sequence, so nothing newer is lost.
    flows.apply_change_stream(stream, f"{folder}/out", f"{folder}/check2", "seq").awaitTermination()
    assert current() == rows_of(expected)


def test_minutes_survive_a_new_checkpoint(spark, sample_rows, folder):
    stream = in_files(spark, sample_rows, "total_changes", f"{folder}/in")
    flows.minute_metric_stream(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    first = rows_of(read_minutes(spark, folder))
    flows.minute_metric_stream(stream, f"{folder}/out", f"{folder}/check2").awaitTermination()
    assert rows_of(read_minutes(spark, folder)) == first


def test_changes_made_during_the_snapshot_are_not_lost(spark):
    changes = spark.createDataFrame([(1, 10, 4, "UPDATE"), (1, 11, 7, "UPDATE"), (2, 5, 5, "INSERT"), (3, 0, 6, "DELETE")],
                                    "id bigint, amount bigint, seq bigint, op_type string")
    snapshot = spark.createDataFrame([(1, 10), (2, 5), (3, 9)], "id bigint, amount bigint")  # taken after change 5
    assert sorted(map(tuple, cdc.apply_changes(snapshot, changes, ["id"], "seq").collect())) == [(1, 11), (2, 5)]


def test_late_rows_beyond_the_watermark_are_dropped(spark, folder):
    first = [(1, START + timedelta(minutes=m), 10, 1, 0, m) for m in range(0, 120, 10)]
    late = [(1, START, 99, 1, 0, 1000), (1, START + timedelta(minutes=115), 50, 1, 0, 1001)]
    for part in (first, late):
        spark.createDataFrame(part, SAMPLE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SAMPLE).parquet(f"{folder}/in")
        query = flows.minute_metric_stream(stream, f"{folder}/out", f"{folder}/check")
        query.awaitTermination()
    got = {r["minute_at"]: r["lag_max_seconds"] for r in read_minutes(spark, folder).collect()}
    assert got[START] == 10 and got[START + timedelta(minutes=115)] == 50
    assert flows.dropped_late(query) == 1


def test_a_wider_watermark_keeps_late_rows(spark, folder):
    first = [(1, START + timedelta(minutes=m), 10, 1, 0, m) for m in range(0, 120, 10)]
    for part in (first, [(1, START, 99, 1, 0, 1000)]):
        spark.createDataFrame(part, SAMPLE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SAMPLE).parquet(f"{folder}/in")
        query = flows.minute_metric_stream(stream, f"{folder}/out", f"{folder}/check", watermark="3 hours")
        query.awaitTermination()
    assert {r["minute_at"]: r["lag_max_seconds"] for r in read_minutes(spark, folder).collect()}[START] == 99
    assert flows.dropped_late(query) == 0


def test_normalisation_drops_what_cannot_be_read(spark):
    at = START
    raw = [("cdc-events-7", at, '{"op":"u","before":{"id":1},"after":{"id":2},"source":{"table":"t"},"ts_ms":1000}'),
           ("cdc-events-7", at, '{"op":"d","before":{"id":1},"after":null}'), ("cdc-events-7", at, "not json"),
           ("cdc-events-7", at, '{"op":"r","after":{"id":1}}'), ("other", at, '{"op":"c","after":{"id":1}}'),
           ("cdc-events-x", at, '{"op":"c","after":{"id":1}}'), ("cdc-events-7", at, None)]
    df = spark.createDataFrame(raw, "topic string, kafka_ts timestamp_ntz, value string")
    events = cdc.with_pipeline(cdc.normalize_cdc(df, "2024-01-01 00:00:05")).orderBy("op_type").collect()
    assert [(e["op_type"], e["data"], e["pipeline_id"], e["table"]) for e in events] == [
        ("DELETE", {"id": "1"}, 7, None), ("UPDATE", {"id": "2"}, 7, "t")]
    assert events[0]["latency_ms"] == 5000 and events[1]["event_ms"] == 1000


def test_schema_policies(spark):
    target, fresh = spark.createDataFrame([(1, "a")], "id bigint, v string"), spark.createDataFrame([(2, "b", 3)], "id bigint, v string, w int")
    assert cdc.evolve(target, cdc.reconcile_schema(fresh, target, "EVOLVE")).columns == ["id", "v", "w"]
    assert cdc.reconcile_schema(fresh, target, "LENIENT").columns == ["id", "v"]
    with pytest.raises(ValueError, match="w"):
        cdc.reconcile_schema(fresh, target, "EXCEPTION")


CHANGE = "id bigint, amount bigint, seq bigint, op_type string"


def test_reads_touch_the_base_and_the_tail(spark, folder):
    rng = random.Random(6)
    batches = [[(rng.randrange(30), rng.randrange(1000), 100 * b + i, rng.choice(["INSERT", "UPDATE", "DELETE"])) for i in range(80)]
               for b in range(6)]
    batches[4] += [(500, 1, 3, "INSERT"), (501, 7, 150, "DELETE")]  # changes that come late, one of a new key
    log, seen = f"{folder}/log", []
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, CHANGE).coalesce(2).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(CHANGE).parquet(f"{folder}/in")
        flows.apply_change_stream(stream, log, f"{folder}/check", "seq").awaitTermination()
        seen += batch
        rows = spark.createDataFrame(seen, CHANGE)
        expected = rows_of(cdc.apply_changes(rows.select("id", "amount").limit(0), rows, ["id"], "seq"))
        current = lambda: rows_of(sinks.read_current(spark, log, ["id"], ["seq"], "seq", "part"))
        assert current() == expected
        base, tail = sinks.base_and_tail(spark, log)
        if number in (1, 3):
            assert sinks.compact(spark, log, ["id"], ["seq"]) == (number + 1) // 2
            assert current() == expected and sinks.base_and_tail(spark, log)[1] is None
            assert sinks.compact(spark, log, ["id"], ["seq"]) == (number + 1) // 2  # nothing new
        elif number > 1:
            assert len(tail.inputFiles()) < len(spark.read.parquet(log).inputFiles()) and tail.count() == {2: 80, 4: 82, 5: 162}[number]
            assert base.count() <= 31
    # A new checkpoint reads everything again into the tail; rows go by their sequence, so nothing changes.
    flows.apply_change_stream(spark.readStream.schema(CHANGE).parquet(f"{folder}/in"), log, f"{folder}/again", "seq").awaitTermination()
    assert current() == expected
    sinks.compact(spark, log, ["id"], ["seq"])
    assert current() == expected


def test_a_compaction_that_stops_leaves_the_old_base(spark, folder):
    rows = spark.createDataFrame([(1, 5, False, "a"), (2, 6, False, "a")], "id long, seq long, is_deleted boolean, day string")
    sinks.append_batch(rows, f"{folder}/log", "day")
    sinks.compact(spark, f"{folder}/log", ["id"], ["seq"])
    sinks.append_batch(rows.withColumn("seq", F.lit(9).cast("long")), f"{folder}/log", "day")
    spark.range(3).write.parquet(f"{folder}/log_base/version=2/half-written")  # no record of it
    got = sinks.read_current(spark, f"{folder}/log", ["id"], ["seq"], "day").collect()
    assert sorted((r.id, r.seq) for r in got) == [(1, 9), (2, 9)]
    assert sinks.compact(spark, f"{folder}/log", ["id"], ["seq"]) == 2
    assert sorted((r.id, r.seq) for r in sinks.read_current(spark, f"{folder}/log", ["id"], ["seq"], "day").collect()) == [(1, 9), (2, 9)]
