"""Helpers of jobs that go round by round: settled plans, and layered frames of what is known so far."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from brightwell.plans.lineage_cut import cut_lineage


@contextmanager
def settled_plans(spark: SparkSession, parts: int) -> Iterator[None]:
    """Plans made inside shuffle to ``parts`` and keep the partitioning they state, so that written frames are joined where
    they lie. Adaptive execution would coalesce each frame its own way and forget it.

    Choose ``parts`` from a counted size: in a single part a round needs no shuffle at all.
    """
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """Parts of about ``each`` rows, no more than the session shuffles to."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)))


class Layers:
    """Written frames that together hold all rows seen; beyond ``most`` of them the two smallest neighbours are merged.

    So there are few frames and a large one is rewritten seldom, whatever the number of rounds. ``merge`` makes one frame of
    two and keeps their partitioning.
    """

    def __init__(self, merge: Callable[[DataFrame, DataFrame], DataFrame], most: int = 6):
        self.merge, self.most, self.frames = merge, most, []

    def add(self, frame: DataFrame, size: int) -> None:
        self.frames.append((frame, size))
        if len(self.frames) > self.most:
            k = min(range(self.most), key=lambda i: self.frames[i][1] + self.frames[i + 1][1])
            (a, n), (b, m) = self.frames[k:k + 2]
            self.frames[k:k + 2] = [(cut_lineage(self.merge(a, b)), n + m)]

    def __iter__(self) -> Iterator[DataFrame]:
        return (frame for frame, _ in self.frames)
