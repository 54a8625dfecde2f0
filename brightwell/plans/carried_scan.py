"""Ordered scans whose state runs through all rows of a key, without putting an unbounded key into one task.

Rules such as "admitted if fewer than n admitted calls lie in the last minute" depend on every earlier row of the key.
Keys are counted first. Those within ``TARGET_ROWS`` are scanned whole, one group per key, in a single pass. Larger
ones are cut into time chunks, each key as finely as its own density asks for. All chunks are scanned at once from an
assumed starting state; then the end state of each chunk is compared with the state its successor assumed, and only
chunks that assumed wrongly are scanned again. When nothing differs any more the result equals the sequential scan:
the first chunk of a key is always right, and every round makes at least the next one right. States that die out over
quiet spells settle in one or two rounds; a key that never falls quiet needs up to one round per chunk, but never a
task larger than a chunk.

``step(state, column)`` scans sorted rows of one key: ``column(name)`` gives a numpy array, the result is ``(state,
{output name: array})``. ``settle(state, first)`` reduces a state to what still matters at a chunk's first moment
(microseconds), so that states that differ only in expired parts count as equal. States are short texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from brightwell.plans.chunks import TARGET_ROWS, split_by_density
from brightwell.plans.joins import null_safe_join
from brightwell.plans.lineage_cut import cut_lineage



def carried_scan(rows: DataFrame, keys: Sequence[str], ts: str, order: str, step: Callable, settle: Callable,
                 output: str, initial: str = "", seconds: int | None = None,
                 target_rows: int = TARGET_ROWS) -> DataFrame:
    """Rows with the columns of ``output`` that ``step`` adds, scanned per key in the order of ``ts`` and ``order``.

    ``seconds`` sets one chunk width for all keys and skips the counting.
    """
    keys = list(keys)
    result = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(output).fields])
    quiet, dense = split_by_density(rows, keys, ts, seconds, target_rows)

    parts = [] if quiet is None else [_sorted_scan(quiet, keys, order, step, result, initial)]
    if dense is not None:
        parts.append(_chunked_scan(dense, keys, order, step, settle, result, initial))
    return reduce(DataFrame.unionByName, parts)


def _numpy(table: pa.Table | pa.RecordBatch) -> Callable[[str], np.ndarray]:
    """Columns as numpy arrays, each converted once and only when a step asks for it."""
    known: dict[str, np.ndarray] = {}

    def column(name: str) -> np.ndarray:
        if name not in known:
            values = table.column(name)
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            known[name] = values.to_numpy(zero_copy_only=False)
        return known[name]

    return column


def _stepped(table: pa.Table, step: Callable, state: str) -> tuple[str, pa.Table]:
    state, out = step(state, _numpy(table))
    for name, values in out.items():
        table = table.append_column(name, pa.array(values))
    return state, table


def _sorted_scan(rows: DataFrame, keys: list[str], order: str, step: Callable, result: T.StructType,
                 initial: str) -> DataFrame:
    """Whole keys, sorted by Spark and streamed in batches; many small keys share a batch and a task.

    Columns that the step does not read pass through as they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, initial
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys])
            starts = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)])
            column, pieces = _numpy(batch), {}
            for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
                key = tuple(batch.column(k)[int(a)].as_py() for k in keys)
                if key != last:
                    last, state = key, initial
                state, out = step(state, lambda name: column(name)[a:b])
                for name, values in out.items():
                    pieces.setdefault(name, []).append(values)
            added = {name: pa.array(np.concatenate(values)) for name, values in pieces.items()}
            yield pa.RecordBatch.from_arrays(
                [added[n] if n in added else batch.column(n) for n in result.names], names=result.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "at_us", order).mapInArrow(run, result)


def _chunked_scan(chunked: DataFrame, keys: list[str], order: str, step: Callable, settle: Callable,
                  result_type: T.StructType, initial: str) -> DataFrame:
    """The chunked form over rows that carry ``at_us`` and ``chunk``."""
    group = [*keys, "chunk"]
    base = T.StructType([chunked.schema[c] for c in group])
    summary_type = T.StructType([*base.fields, T.StructField("first_us", T.LongType()),
                                 T.StructField("state_in", T.StringType()), T.StructField("state_out", T.StringType())])

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([("at_us", "ascending"), (order, "ascending")])

    def summary_of(table: pa.Table, state: str) -> pa.Table:
        table = ordered(table)
        out, _ = _stepped(table, step, state)
        row = table.slice(0, 1).select([*group, "at_us"]).rename_columns([*group, "first_us"])
        return row.append_column("state_in", pa.array([state], pa.string())).append_column(
            "state_out", pa.array([out], pa.string()))

    def first_pass(table: pa.Table) -> pa.Table:
        return summary_of(table, initial)

    def again(table: pa.Table, wanted: pa.Table) -> pa.Table:
        return summary_of(table, wanted.column("wanted")[0].as_py())

    @F.pandas_udf("string")
    def settled(state: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([initial if s is None else settle(s, int(f)) for s, f in zip(state, first)], dtype=object)

    summary = cut_lineage(chunked.groupBy(*group).applyInArrow(first_pass, summary_type))
    before = Window.partitionBy(*keys).orderBy("chunk")  # one row per chunk of a key, not per row
    for _ in range(summary.count() + 1):  # no key needs more rounds than it has chunks
        assumed = summary.withColumn("carried", F.lag("state_out").over(before))
        wrong = assumed.withColumn("wanted", settled("carried", "first_us")).filter(
            F.col("wanted") != F.col("state_in")).select(*group, "wanted")
        wrong = cut_lineage(wrong)
        if wrong.isEmpty():
            break
        # Only chunks to repeat reach Python: the other rows are dropped by the semi-join.
        redo = null_safe_join(chunked, wrong.select(*group), group, "left_semi")
        fixed = redo.groupBy(*group).cogroup(wrong.groupBy(*group)).applyInArrow(again, summary_type)
        summary = cut_lineage(null_safe_join(summary, wrong.select(*group), group, "left_anti").select(
            *summary_type.names).unionByName(fixed))
    else:
        raise RuntimeError("the scan did not settle: step must be a function of state and rows")

    def emit(table: pa.Table, start: pa.Table) -> pa.Table:
        return _stepped(ordered(table), step, start.column("state_in")[0].as_py())[1].select(result_type.names)

    # Both sides hold the same chunks, so every group has rows and one state.
    states = summary.select(*group, "state_in")
    return chunked.groupBy(*group).cogroup(states.groupBy(*group)).applyInArrow(emit, result_type)
