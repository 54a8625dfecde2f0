"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000


def known(df: DataFrame, rows: int, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a narrow side for broadcast if its row count, already taken, is at most ``max_rows``; else the planner decides.

    Sides whose size is not known beforehand need no mark: adaptive execution broadcasts what turns out small.
    """
    return F.broadcast(df) if rows <= max_rows else df
