"""Joins in which null keys meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the planner still hashes on the keys."""
    renamed = {k: f"right_{k}" for k in key}
    right = right.withColumnsRenamed(renamed)
    joined = left.join(right, [F.col(k).eqNullSafe(F.col(renamed[k])) for k in key], how)
    if how in ("left_semi", "left_anti"):
        return joined
    keys = [F.coalesce(k, renamed[k]).alias(k) for k in key] if how in ("right", "full") else [F.col(k) for k in key]
    rest = [c for c in joined.columns if c not in key and c not in renamed.values()]
    return joined.select(*keys, *rest)
