"""Sequential per-key rules on streams, in the order of event time.

The steps are those of the batch scans. Rows wait in the state store, cut into slices of event time, until the watermark
has passed their slice; a timer then takes the slice, sorts it and hands it to the step together with the carried state.
So rows may come in any order within the watermark, later ones are dropped and counted, and a task holds one slice of one
key at a time. A carried state that says nothing is not kept, and any other goes when its key has been silent for the
time the rule names, also by a timer.

Every access to the state store is a call out of Python. Rules over many keys therefore share their state by ``buckets``
of keys: a task then holds one slice of one bucket, and calls grow with buckets and slices, not with keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brightwell.operators import cdc, replay

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Defaults: how far rows may be out of order, the width of a slice, and after how long a silent key is forgotten.
WATERMARK, SLICE_S, FORGET_S = "10 seconds", 10, 86_400
EVENT_TIME, KEY, BUCKET = "event_time", "scan_key", "scan_bucket"
#: Buckets of the rules over many keys. More make a task's slice smaller and cost calls; a checkpoint holds to its number.
BUCKETS = 256


class OrderedScan(StatefulProcessor):
    """Feeds each key's rows to ``step(state, column)`` in order of time; see the module.

    A group of the stream is one key, or with ``many`` a bucket of keys that ``KEY`` tells apart. State: ``pending`` holds
    the rows of a slice as they came, in numbered parts; ``parts`` counts these; ``carried`` is the step's state with the
    end of the last slice it saw, for a bucket the JSON object of both by key.
    """

    def __init__(self, step: Callable, order: str, columns: Sequence[str], slice_ms: int, forget_ms: int, many: bool = False):
        self.step, self.order, self.columns = step, order, list(columns)
        self.slice_ms, self.forget_ms, self.many = slice_ms, forget_ms, many

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "slice bigint, part int", "rows binary")
        self.parts = handle.getMapState("parts", "slice bigint", "n int")
        self.carried = handle.getValueState("carried", "state string, seen_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for frame in rows:
            frame = frame.drop(columns=EVENT_TIME)
            slices = frame["at_us"].to_numpy() // (1000 * self.slice_ms)
            for number in np.unique(slices).tolist():
                if number not in counts:
                    counts[number] = self.parts.getValue((number,))[0] if self.parts.containsKey((number,)) else 0
                    if counts[number] == 0:
                        self.handle.registerTimer((number + 1) * self.slice_ms)
                self.pending.updateValue((number, counts[number]), (packed(frame[slices == number]),))
                counts[number] += 1
        for number, n in counts.items():
            self.parts.updateValue((number,), (n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(number for (number,) in self.parts.keys() if (number + 1) * self.slice_ms <= now)
        held = self._held()
        for number in due:
            yield self._scanned(number, held)
        # The slice in which the time runs out has been scanned by then.
        kept = {k: (state, seen) for k, (state, seen) in held.items() if seen + self.forget_ms + self.slice_ms > now}
        if kept and (due or len(kept) < len(held)):
            last = max(seen for _, seen in kept.values())
            self.carried.update((json.dumps(kept) if self.many else kept[""][0], last))
        elif not kept:
            self.carried.clear()

    def _held(self) -> dict[str, tuple[str, int]]:
        """The carried states by key, each with the end of the last slice it saw."""
        if not self.carried.exists():
            return {}
        state, seen = self.carried.get()
        return json.loads(state) if self.many else {"": (state, seen)}

    def _scanned(self, number: int, held: dict[str, tuple[str, int]]) -> pd.DataFrame:
        places = [(number, part) for part in range(self.parts.getValue((number,))[0])]
        frames = [unpacked(self.pending.getValue(place)[0]) for place in places]
        for place in places:
            self.pending.removeKey(place)
        self.parts.removeKey((number,))
        rows = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]  # one slice of one group
        rows = rows.sort_values([*([KEY] if self.many else []), "at_us", self.order], kind="stable", ignore_index=True)
        names = rows[KEY].to_numpy() if self.many else np.full(len(rows), "")
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]).tolist()
        begin, end, known, pieces, left = number * self.slice_ms, (number + 1) * self.slice_ms, {}, {}, False

        def column(name: str) -> np.ndarray:
            if name not in known:
                known[name] = rows[name].to_numpy()
            return known[name]

        for a, b in zip(starts, [*starts[1:], len(rows)]):
            name = str(names[a])
            state, seen = held.pop(name, ("", 0))
            before = state if seen + self.forget_ms > begin else ""
            after, out = self.step(before, lambda c: column(c)[a:b])
            if after:
                held[name], left = (after, end), True
            for c, values in out.items():
                pieces.setdefault(c, []).append(values)
        if left:
            self.handle.registerTimer(end + self.forget_ms + self.slice_ms)
        return rows.assign(**{c: np.concatenate(values) for c, values in pieces.items()})[self.columns]

    def close(self) -> None:
        pass


def packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_pandas()


def scan_stream(rows: DataFrame, keys: Sequence[str], ts: str, order: str, step: Callable, output: str,
                forget_s: int = FORGET_S, watermark: str = WATERMARK, slice_s: int = SLICE_S,
                buckets: int | None = None) -> DataFrame:
    """Applies ``step(state, column)`` to each key's rows in order of ``ts`` and ``order``, keeping its state.

    A row is answered once the watermark has passed its slice. A key without rows for ``forget_s`` starts anew; a window
    rule passes its window, after which its state says nothing. Rows without a moment are dropped. Whole-number keys
    travel as text, since pandas would turn a key column with nulls into fractions, and ``ts`` as microseconds, since a
    frame builds an object for every moment. Without ``buckets`` every key has a
    state of its own, which suits few keys with many rows each.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    fields = rows.schema.fields
    fragile = {f.name: f.dataType for f in fields if isinstance(f.dataType, T.LongType) and f.name in keys}
    moment = F.col(ts).cast("timestamp")
    timed = rows.filter(F.col(ts).isNotNull()).withColumns({EVENT_TIME: moment, "at_us": F.unix_micros(moment)})
    keyed = timed.withWatermark(EVENT_TIME, watermark).withColumns({name: F.col(name).cast("string") for name in fragile})
    kind, back = rows.schema[ts].dataType, None
    if isinstance(kind, T.TimestampType):
        keyed, back = keyed.withColumn(ts, F.col("at_us")), F.timestamp_micros(ts)
    elif isinstance(kind, T.TimestampNTZType):
        zero = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
        keyed = keyed.withColumn(ts, F.expr(f"timestampdiff(MICROSECOND, {zero}, `{ts}`)"))
        back = F.expr(f"timestampadd(MICROSECOND, `{ts}`, {zero})")
    sent = {**{name: T.StringType() for name in fragile}, **({ts: T.LongType()} if back is not None else {})}
    result = T.StructType([*[T.StructField(f.name, sent.get(f.name, f.dataType)) for f in fields],
                           *T.StructType.fromDDL(output).fields])
    if buckets:
        # A JSON object leaves out nulls, so it tells every two keys apart.
        keyed = keyed.withColumns({KEY: F.to_json(F.struct(*keys)), BUCKET: F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")})
    scan = OrderedScan(step, order, result.names, 1000 * slice_s, 1000 * forget_s, bool(buckets))
    groups = [BUCKET] if buckets else keys
    scanned = keyed.groupBy(*groups).transformWithStateInPandas(scan, result, "append", "eventTime")
    shown = {ts: back} if back is not None else {}
    return scanned.withColumns(shown | {name: F.col(name).cast(whole) for name, whole in fragile.items()})


def rate_limit_stream(log: DataFrame, limits: DataFrame, window_s: int = replay.RATE_WINDOW_S,
                      key: str = "key_id", buckets: int | None = BUCKETS,
                      **plan) -> DataFrame:
    # Of several limits for a key the strictest holds, so no call is doubled.
    bounds = limits.groupBy(key).agg(F.min(F.col("qps_limit").cast("int")).alias("qps_limit"))
    joined = log.join(bounds, key, "left").withColumn("qps_limit", F.coalesce("qps_limit", F.lit(0)))
    step, _ = replay.window_step(window_s * 1_000_000, "admitted", "qps_limit", calls=None)
    return scan_stream(joined, [key], "created_at", "id", step, "admitted boolean", window_s, buckets=buckets, **plan)


def dedupe_stream(alerts: DataFrame, keys: Sequence[str] = ("object_type", "object_id", "alert_type"),
                  window_s: int = replay.ALERT_WINDOW_S, ts: str = "fired_at", buckets: int | None = BUCKETS,
                  **plan) -> DataFrame:
    """Each alert with ``sent``, as ``replay.dedupe_alerts``; a key is forgotten once its window is over."""
    step, _ = replay.window_step(window_s * 1_000_000, "sent", calls=None)
    return scan_stream(alerts, keys, ts, "id", step, "sent boolean", window_s, buckets=buckets, **plan)


def circuit_stream(log: DataFrame, key: str, size: int = replay.BREAKER_SIZE, wait_s: int = replay.BREAKER_WAIT_S,
                   share: float = replay.BREAKER_FAILURE_SHARE, ts: str = "created_at", buckets: int | None = BUCKETS,
                   **plan) -> DataFrame:
    step, _ = replay.breaker_step(size, share, wait_s * 1_000_000)
    return scan_stream(log, [key], ts, "id", step, "breaker string, admitted boolean", buckets=buckets, **plan)


def lag_alert_stream(samples: DataFrame, threshold: int = cdc.LAG_WARN_SECONDS, ts: str = "sampled_at",
                     order: str = "total_changes", **plan) -> DataFrame:
    """Samples at which the lag rises above the threshold; only pipelines that are late keep a state."""
    def step(state: str, column):
        late = column("lag_seconds") > threshold
        was = np.r_[state == "late", late[:-1]]
        return "late" if late[-1] else "", {"fires": late & ~was}

    scanned = scan_stream(samples, ["pipeline_id"], ts, order, step, "fires boolean", **plan)
    return scanned.filter("fires").drop("fires")


def miss_stream(polls: DataFrame, n: int = cdc.NOT_FOUND_POLLS, ts: str = "sampled_at", order: str = "total_changes",
                missing: str = "is_missing", **plan) -> DataFrame:
    """Polls that complete ``n`` misses in a row; ``missing`` names the boolean column. Only missing jobs keep a state."""
    def step(state: str, column):
        met = np.array([bool(m) for m in column(missing)])
        position = np.arange(1, len(met) + 1)
        reset = np.maximum.accumulate(np.where(met, -int(state or 0), position))
        length = np.where(met, position - reset, 0)
        return str(int(length[-1]) or ""), {"misses": length.astype("int64")}

    scanned = scan_stream(polls, ["pipeline_id"], ts, order, step, "misses bigint", **plan)
    return scanned.filter((F.col("misses") > 0) & (F.col("misses") % n == 0))
