"""Registration of queries together with their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from registry.views import Lake, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Lake], DataFrame]
    sql: str | None


class Registry:
    def __init__(self):
        self.items: dict[str, Query] = {}

    def query(self, name: str, sql: str | None = None):
        def register(build):
            if name in self.items:
                raise ValueError(f"{name} is registered twice")
            self.items[name] = Query(name, build, None if sql is None else with_views(sql))
            return build
        return register


def shown(df: DataFrame, **casts: str) -> DataFrame:
    """Casts for display: decimals as doubles, dates as text, arrays joined, so both engines print alike."""
    columns = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if field.name in casts:
            col = col.cast(casts[field.name])
        elif kind.startswith("decimal"):
            col = col.cast("double")
        elif kind == "date":
            col = col.cast("string")
        elif kind == "array":
            col = F.array_join(col.cast("array<string>"), ",")
        elif kind == "timestamp":
            col = col.cast("timestamp_ntz")
        columns.append(col.alias(field.name))
    return df.select(*columns)


def leafed(page: Callable[[dict | None], DataFrame], keys: list[str], number: int) -> DataFrame:
    """The ``number``-th page of a caller who leafs on, each time behind the last row seen; ``page`` gives a page's rows in
    order. Only one row of a page is looked at, as a caller would."""
    rows = page(None)
    for _ in range(number - 1):
        last = rows.tail(1)
        if not last:
            return rows
        rows = page({k: last[0][k] for k in keys})
    return rows
