"""Replays of sequential rules over logs: rate limits, circuit breakers and alert de-duplication."""

from __future__ import annotations

import json
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from brightwell.plans.carried_scan import carried_scan

# Windows, thresholds and waits of the live rules.
RATE_WINDOW_S = 60
ALERT_WINDOW_S = 60
BREAKER_SIZE, BREAKER_FAILURE_SHARE, BREAKER_WAIT_S = 5, 0.5, 30


def admit_within(times: np.ndarray, calls: np.ndarray, limit: int, window: int,
                 recent: list[list[int]]) -> tuple[np.ndarray, list[list[int]]]:
    """How many of the ``calls`` at each of the sorted ``times`` pass when at most ``limit`` passed ones may lie in the
    ``window`` before a call. ``recent`` holds ``[moment, passed]`` pairs.

    Once the window is full, the scan jumps to the first moment after the oldest passed calls expire.
    """
    if limit <= 0:
        return calls.copy(), []
    passed = np.zeros(len(times), dtype="int64")
    held, i = deque(map(tuple, recent)), 0
    used = sum(n for _, n in held)
    while i < len(times):
        now = int(times[i])
        while held and held[0][0] <= now - window:
            used -= held.popleft()[1]
        if used < limit:
            n = min(int(calls[i]), limit - used)
            passed[i] = n
            held.append((now, n))
            used += n
            i += 1
        else:
            i = max(i + 1, int(np.searchsorted(times, held[0][0] + window, side="left")))
    end = int(times[-1]) if len(times) else 0
    return passed, [[t, n] for t, n in held if t > end - window]


def window_step(window_us: int, out: str, limit_column: str | None = None, limit: int = 1, calls: str | None = "calls"):
    """``(step, settle)`` of a sliding-window rule on a millisecond clock, as the live rule reads it.

    The state lists the moments with passed calls still in the window. Without a ``calls`` column every row is one
    call and the output is a flag.
    """
    def step(state: str, column):
        bound = limit if limit_column is None else int(column(limit_column)[0])
        times = column("at_us") // 1000 * 1000
        counts = np.ones(len(times), dtype="int64") if calls is None else column(calls)
        passed, held = admit_within(times, counts, bound, window_us, json.loads(state or "[]"))
        return json.dumps(held) if held else "", {out: passed > 0 if calls is None else passed}

    def settle(state: str, first: int) -> str:
        held = [pair for pair in json.loads(state or "[]") if pair[0] > first - window_us]
        return json.dumps(held) if held else ""

    return step, settle


def _sliding(rows: DataFrame, keys: list[str], ts: str, order: str, out: str, step, settle, carried: list[str],
             **plan) -> DataFrame:
    """Flags rows by a sliding-window rule.

    Calls of one key in one millisecond are interchangeable but for their order, so only (key, moment, calls) is
    scanned in sequence. The rows themselves are spread by key and moment and compared with how many passed there, so
    a hot key never gathers in a task.
    """
    moment = F.date_trunc("millisecond", F.col(ts)).cast("timestamp_ntz")
    timed = rows.withColumn("moment", moment)
    moments = timed.groupBy(*keys, *carried, "moment").agg(F.count("*").alias("calls"))
    scanned = carried_scan(moments, keys, "moment", "moment", step, settle, "passed bigint", **plan)
    # Inside a struct null keys are equal, and rank and join share one shuffle on it.
    cell = F.struct(*keys, "moment").alias("cell")
    turn = F.row_number().over(Window.partitionBy("cell").orderBy(order))
    ranked = timed.select(*rows.columns, cell).withColumn("turn", turn)
    joined = ranked.join(scanned.select(cell, "passed"), "cell")
    return joined.select(*rows.columns, (F.col("turn") <= F.col("passed")).alias(out))


def rate_limit_replay(log: DataFrame, limits: DataFrame, window_s: int = RATE_WINDOW_S, key: str = "key_id",
                      **plan) -> DataFrame:
    """Each call with ``admitted``: fewer than the key's limit of admitted calls lie in the window before it.

    Keys without a positive limit admit everything and take no part in the scan.
    """
    # Of several limits for a key the strictest holds, so no call is doubled.
    bounds = limits.groupBy(key).agg(F.min(F.col("qps_limit").cast("int")).alias("qps_limit"))
    joined = log.join(bounds, key, "left").withColumn("qps_limit", F.coalesce("qps_limit", F.lit(0)))
    free = joined.filter(F.col("qps_limit") <= 0).withColumn("admitted", F.lit(True))
    step, settle = window_step(window_s * 1_000_000, "passed", "qps_limit")
    bound = _sliding(joined.filter(F.col("qps_limit") > 0), [key], "created_at", "id", "admitted", step, settle,
                     ["qps_limit"], **plan)
    return free.unionByName(bound)


def dedupe_alerts(alerts: DataFrame, keys: tuple[str, ...] = ("object_type", "object_id", "alert_type"),
                  window_s: int = ALERT_WINDOW_S, ts: str = "fired_at", **plan) -> DataFrame:
    """Each alert with ``sent``: no alert of the same keys was sent in the window before it."""
    step, settle = window_step(window_s * 1_000_000, "passed")
    return _sliding(alerts, list(keys), ts, "id", "sent", step, settle, [], **plan)


def breaker_step(size: int, share: float, wait_us: int):
    """``(step, settle)`` of a count-window breaker with one probe after the wait.

    State: ``mode|since|outcomes`` with the outcomes of the last calls, 1 for a failure.
    """
    def step(state: str, column):
        mode, since, seen = (state or "CLOSED|0|").split("|")
        since, window = int(since), deque((int(c) for c in seen), maxlen=size)
        modes, admitted = [], []
        for now, failed in zip(column("at_us").tolist(), column("failed").tolist()):
            if mode == "OPEN" and now >= since + wait_us:
                mode = "HALF_OPEN"
            modes.append(mode)
            admitted.append(mode != "OPEN")
            if mode == "HALF_OPEN":
                window.clear()
                mode, since = ("OPEN", now) if failed else ("CLOSED", 0)
            elif mode == "CLOSED":
                window.append(1 if failed else 0)
                if len(window) == size and sum(window) >= share * size:
                    mode, since = "OPEN", now
                    window.clear()
        return f"{mode}|{since}|{''.join(map(str, window))}", {"breaker": np.array(modes, dtype=object), "admitted": np.array(admitted)}

    def settle(state: str, first: int) -> str:
        mode, since, seen = (state or "CLOSED|0|").split("|")
        if mode == "OPEN" and first >= int(since) + wait_us:
            return "HALF_OPEN|0|"
        return "" if (mode, seen) == ("CLOSED", "") else state

    return step, settle


def circuit_replay(log: DataFrame, key: str, size: int = BREAKER_SIZE, wait_s: int = BREAKER_WAIT_S,
                   share: float = BREAKER_FAILURE_SHARE, ts: str = "created_at", **plan) -> DataFrame:
    """Each call of a source with the breaker's mode and whether it would have been let through.

    ``log`` carries a boolean ``failed``. The breaker opens when a full window of the last ``size`` calls holds the
    failure share, rejects for ``wait_s`` seconds, then lets one probe decide.
    """
    step, settle = breaker_step(size, share, wait_s * 1_000_000)
    return carried_scan(log, [key], ts, "id", step, settle, "breaker string, admitted boolean", **plan)
