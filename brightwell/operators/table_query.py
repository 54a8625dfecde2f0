"""Parameterised reads of one table, and statements with named parameters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from brightwell.plans.seek import page_of, sorted_by

# Limits of a definition, shapes of names and parameters, page sizes, system parameter formats.
MAX_FILTERS, MAX_FIELDS = 20, 100
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,63}$")
ORDER_BY = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,63}(\s+(?i:ASC|DESC))?$")
WHOLE, FRACTION = re.compile(r"^-?\d+$"), re.compile(r"^-?\d+\.\d+$")
DEFAULT_PAGE, DEFAULT_PAGE_MAX, PAGE_HARD_MAX = 20, 100, 1000
PLACEHOLDER = re.compile(r"\$\{([^}]+)\}")
DAY_FORMAT, MOMENT_FORMAT = "%Y-%m-%d", "%Y-%m-%d %H:%M:%S"


@dataclass(frozen=True)
class QuerySpec:
    """What callers may ask of a table: filters as (field, EQ or RANGE), fields shown, order and page bounds."""

    filters: Sequence[tuple[str, str]] = ()
    fields: Sequence[str] = ()
    order_by: str | None = None
    paginated: bool = False
    page_size_max: int = DEFAULT_PAGE_MAX
    tie_break: Sequence[str] = field(default_factory=tuple)

    def checked(self, columns: Sequence[str]) -> QuerySpec:
        """The definition without repetitions, or an error that names what is wrong."""
        filters = list(dict.fromkeys((f.strip(), kind.strip().upper()) for f, kind in self.filters))
        shown = list(dict.fromkeys(f.strip() for f in self.fields))
        if len(self.filters) > MAX_FILTERS or len(self.fields) > MAX_FIELDS:
            raise ValueError(f"at most {MAX_FILTERS} filters and {MAX_FIELDS} fields")
        order = (self.order_by or "").strip()
        if order and not ORDER_BY.match(order):
            raise ValueError(f"order must be a column and ASC or DESC: {order}")
        for name in [f for f, _ in filters] + shown + order.split()[:1] + list(self.tie_break):
            if not IDENTIFIER.match(name) or name not in columns:
                raise ValueError(f"unknown column {name}")
        if bad := [kind for _, kind in filters if kind not in ("EQ", "RANGE")]:
            raise ValueError(f"unknown filter {bad[0]}")
        if not 1 <= self.page_size_max <= PAGE_HARD_MAX:
            raise ValueError(f"the page size must lie between 1 and {PAGE_HARD_MAX}")
        return QuerySpec(filters, shown, order or None, self.paginated, self.page_size_max, tuple(self.tie_break))


def typed(text: str):
    """A request parameter as whole number, decimal or text, by its shape."""
    value = text.strip()
    if WHOLE.match(value) and -2 ** 63 <= int(value) < 2 ** 63:
        return int(value)
    return Decimal(value) if FRACTION.match(value) and len(value) <= 38 else value


def _literal(text: str, kind: T.DataType) -> Column:
    """The parameter in a type that compares with the column; text against a number matches nothing."""
    value = typed(text)
    if isinstance(kind, T.NumericType):
        return F.lit(None).cast(kind) if isinstance(value, str) else F.lit(value)
    return F.lit(text.strip()).try_cast(kind)


def conditions(df: DataFrame, spec: QuerySpec, params: Mapping[str, str]) -> list[Column]:
    """One condition per parameter given; blank or missing parameters set none."""
    given = lambda name: (params.get(name) or "").strip()
    found = []
    for name, kind in spec.filters:
        col, data_type = F.col(name), df.schema[name].dataType
        if kind == "EQ" and given(name):
            found.append(col == _literal(given(name), data_type))
        if kind == "RANGE" and given(f"min_{name}"):
            found.append(col >= _literal(given(f"min_{name}"), data_type))
        if kind == "RANGE" and given(f"max_{name}"):
            found.append(col <= _literal(given(f"max_{name}"), data_type))
    return found


def _filtered(df: DataFrame, spec: QuerySpec, params: Mapping[str, str]) -> DataFrame:
    found = conditions(df, spec, params)
    return df.filter(reduce(lambda a, b: a & b, found)) if found else df


def page_bounds(page: int | None, size: int | None, size_max: int) -> tuple[int, int]:
    """``(offset, size)``; the size used is at most the one the definition declares, and callers are given it."""
    size = max(1, min(DEFAULT_PAGE if size is None else size, size_max))
    return max((page or 1) - 1, 0) * size, size


def table_query(df: DataFrame, spec: QuerySpec, params: Mapping[str, str] | None = None, page: int | None = None,
                size: int | None = None, after: Mapping[str, object] | None = None) -> DataFrame:
    """The rows a caller asked for. Filters and columns reach the scan; a page is a top-n, not a full sort.

    A page may be named by its number, or by the values that the last row seen has in the order's columns (``after``): then
    no task gathers more than one page.
    """
    spec = spec.checked(df.columns)
    rows = _filtered(df, spec, params or {})
    order = [(c, False) for c in spec.tie_break]
    if spec.order_by:
        name, _, way = spec.order_by.partition(" ")
        order.insert(0, (name, way.strip().upper() == "DESC"))
    if spec.paginated:
        _, size = page_bounds(page, size, spec.page_size_max)
        rows = page_of(rows, order, size, page or 1, after)
    elif order:
        rows = rows.orderBy(*sorted_by(order))
    return rows.select(*spec.fields) if spec.fields else rows


def table_count(df: DataFrame, spec: QuerySpec, params: Mapping[str, str] | None = None) -> DataFrame:
    """How many rows the same conditions leave."""
    return _filtered(df, spec.checked(df.columns), params or {}).agg(F.count("*").alias("total"))


def mentioning(df: DataFrame, like: Mapping[str | tuple[str, ...], str]) -> DataFrame:
    """Rows in which each word occurs in its column, or in any of its columns; blank words test nothing."""
    from brightwell.functions.values import escaped_contains

    for names, word in like.items():
        if word and word.strip():
            names = (names,) if isinstance(names, str) else names
            tests = [F.coalesce(escaped_contains(F.col(n), word.strip()), F.lit(False)) for n in names]
            df = df.filter(reduce(lambda a, b: a | b, tests))
    return df


def history_page(df: DataFrame, spec: QuerySpec, params: Mapping[str, str] | None = None,
                 like: Mapping[str | tuple[str, ...], str] | None = None, page: int = 1, size: int = 20,
                 after: Mapping[str, object] | None = None) -> DataFrame:
    """A page of a history log: the conditions of ``spec`` and substring tests as in :func:`mentioning`."""
    return table_query(mentioning(df, like or {}), spec, params, page, size, after)


def history_count(df: DataFrame, spec: QuerySpec, params: Mapping[str, str] | None = None,
                  like: Mapping[str | tuple[str, ...], str] | None = None) -> DataFrame:
    """How many rows :func:`history_page` pages through."""
    return table_count(mentioning(df, like or {}), spec, params)


def total(df: DataFrame) -> DataFrame:
    """The number of rows a page is cut from."""
    return df.agg(F.count("*").alias("total"))


def resolve_parameters(as_of: datetime, defaults: Mapping[str, str] | None = None,
                       overrides: Mapping[str, object] | None = None) -> dict[str, object]:
    """System parameters, then defaults that do not hide them, then manual values over everything."""
    found: dict[str, object] = {"biz_date": (as_of - timedelta(days=1)).strftime(DAY_FORMAT),
                                "current_time": as_of.strftime(MOMENT_FORMAT)}
    for name, value in (defaults or {}).items():
        if value is not None and str(value).strip():
            found.setdefault(name, value)
    return found | dict(overrides or {})


def replace_placeholders(text: str, params: Mapping[str, object]) -> str:
    """``${name}`` replaced by its value with quotes doubled; unknown names stay."""
    def fill(match: re.Match) -> str:
        value = params.get(match.group(1))
        return match.group() if value is None else str(value).replace("'", "''")
    return PLACEHOLDER.sub(fill, text or "")


def run_sql(spark: SparkSession, sql: str, as_of: datetime, defaults: Mapping[str, str] | None = None,
            overrides: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """A statement with ``:name`` markers bound as typed arguments and ``${name}`` placeholders filled in."""
    params = resolve_parameters(as_of, defaults, overrides)
    text = replace_placeholders(sql, params)
    marked = {n: v for n, v in params.items() if re.search(rf"(?<!:):{re.escape(n)}\b", text)}
    return spark.sql(text, args=marked or None, **tables)
