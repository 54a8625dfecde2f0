"""Pages that start behind a given row instead of skipping those before it.

The condition on the first column of the order is stated on its own, so it reaches the scan; every task then keeps one page
of rows at most, however deep the page lies. Ascending columns have their nulls first, descending ones last.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Column name and whether it runs downwards; together they must tell rows apart.
Order = Sequence[tuple[str, bool]]


def _behind(col: Column, down: bool, value) -> Column:
    if value is None:
        return F.lit(False) if down else col.isNotNull()
    return (col < F.lit(value)) | col.isNull() if down else col > F.lit(value)


def behind(order: Order, last: Mapping[str, object]) -> Column:
    """Rows that come after the one with the values of ``last``."""
    (first, down), value = order[0], last[order[0][0]]
    col = F.col(first)
    coarse = F.lit(True)
    if value is not None:
        coarse = (col <= F.lit(value)) | col.isNull() if down else col >= F.lit(value)
    elif down:
        coarse = col.isNull()
    steps, same = [], F.lit(True)
    for name, down in order:
        steps.append(same & _behind(F.col(name), down, last[name]))
        same = same & F.col(name).eqNullSafe(F.lit(last[name]))
    return coarse & reduce(Column.__or__, steps)


def sorted_by(order: Order) -> list[Column]:
    return [F.desc(name) if down else F.asc(name) for name, down in order]


def page_of(rows: DataFrame, order: Order, size: int, page: int = 1, after: Mapping[str, object] | None = None) -> DataFrame:
    """A page by its number, or, if ``after`` holds the order's values of the last row seen, the ``size`` rows behind it."""
    if after is not None:
        return rows.filter(behind(order, after)).orderBy(*sorted_by(order)).limit(size)
    return rows.orderBy(*sorted_by(order)).offset((max(page, 1) - 1) * size).limit(size)
