"""Sequential rules against a plain loop, with chunks small enough that state crosses many borders."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brightwell.operators import replay

START = datetime(2024, 1, 1)


def calls(seed, n=600, keys=4, hot=0.4, spread=3_000):
    """Rows of (id, key, limit, moment, failed); one key holds a large share."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < hot else rng.randrange(1, keys)
        rows.append((i, key, START + timedelta(milliseconds=rng.randrange(spread) * 1000), rng.random() < 0.4))
    return rows


def loop_limits(rows, limit_of, window):
    held, out = {}, {}
    for i, key, at, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        recent = [t for t in held.get(key, []) if t > at - timedelta(seconds=window)]
        ok = limit_of(key) <= 0 or len(recent) < limit_of(key)
        if ok and limit_of(key) > 0:
            recent.append(at)
        held[key], out[i] = recent, ok
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("plan", [{"seconds": 50}, {"seconds": 100_000}, {"target_rows": 60}, {}])
def test_rate_limit_equals_a_loop(spark, seed, plan):
    rows = calls(seed)
    log = spark.createDataFrame(rows, "id bigint, key_id bigint, created_at timestamp_ntz, failed boolean")
    limits = spark.createDataFrame([(0, 3), (1, 1), (2, 0)], "key_id bigint, qps_limit int")
    got = replay.rate_limit_replay(log, limits, 60, **plan)
    expected = loop_limits(rows, lambda k: {0: 3, 1: 1}.get(k, 0), 60)
    assert {r["id"]: r["admitted"] for r in got.collect()} == expected


@pytest.mark.parametrize("plan", [{"seconds": 45}, {"target_rows": 50}, {}])
def test_dedupe_equals_a_loop(spark, plan):
    rows = calls(7, n=400)
    alerts = spark.createDataFrame([(i, "DAG", k or None, "FAILURE", at) for i, k, at, _ in rows],
                                   "id bigint, object_type string, object_id bigint, alert_type string, fired_at timestamp_ntz")
    got = replay.dedupe_alerts(alerts, **plan)
    assert {r["id"]: r["sent"] for r in got.collect()} == loop_limits(rows, lambda k: 1, 60)


def loop_breaker(rows, size=5, wait=30):
    out, state = {}, {}
    for i, key, at, failed in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        mode, since, seen = state.get(key, ("CLOSED", None, []))
        if mode == "OPEN" and at >= since + timedelta(seconds=wait):
            mode = "HALF_OPEN"
        out[i] = mode
        if mode == "HALF_OPEN":
            mode, since, seen = ("OPEN", at, []) if failed else ("CLOSED", None, [])
        elif mode == "CLOSED":
            seen = (seen + [failed])[-size:]
            if len(seen) == size and sum(seen) * 2 >= size:
                mode, since, seen = "OPEN", at, []
        state[key] = (mode, since, seen)
    return out


@pytest.mark.parametrize("plan", [{"seconds": 40}, {}])
def test_breaker_equals_a_loop(spark, plan):
    rows = calls(3)
    log = spark.createDataFrame(rows, "id bigint, key_id bigint, created_at timestamp_ntz, failed boolean")
    got = replay.circuit_replay(log, "key_id", **plan)
    assert {r["id"]: r["breaker"] for r in got.collect()} == loop_breaker(rows)


def test_many_calls_in_one_millisecond(spark):
    rows = [(i, 1, START + timedelta(microseconds=i % 900), False) for i in range(300)]
    rows += [(300 + i, 1, START + timedelta(seconds=60, microseconds=i), False) for i in range(100)]
    log = spark.createDataFrame(rows, "id bigint, key_id bigint, created_at timestamp_ntz, failed boolean")
    limits = spark.createDataFrame([(1, 40)], "key_id bigint, qps_limit int")
    got = sorted(r["id"] for r in replay.rate_limit_replay(log, limits).filter("admitted").collect())
    assert got == [*range(40), *range(300, 340)]


def test_free_keys_never_reach_python(spark):
    log = spark.createDataFrame(calls(5), "id bigint, key_id bigint, created_at timestamp_ntz, failed boolean")
    limits = spark.createDataFrame([(9, 1)], "key_id bigint, qps_limit int")
    got = replay.rate_limit_replay(log, limits, 60, seconds=500)
    assert got.filter(~F.col("admitted")).count() == 0 and got.count() == 600
