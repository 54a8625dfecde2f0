"""SimHash near-duplicates through vantage-point trees.

A tree over a small sample of the fingerprints cuts the space into shards: at each node a fingerprint goes left if its
Hamming distance to the vantage point is at most the node's bound. Each fingerprint is stored in one shard. As a query
it also visits every shard that its ball of ``bits`` overlaps, which the triangle inequality decides at each node. Inside
a shard the same splitting goes on in memory until few fingerprints are left, and these are compared exactly. Equal
fingerprints are one node from the start, so the number of copies of a text does not matter. Links are closed to
components by rounds of minimum labels on DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from brightwell.llm.batches import map_batches, pieces
from brightwell.llm.shared import written
from brightwell.plans.lineage_cut import cut_lineage

SEED = 42
#: Fingerprints a shard should hold, fingerprints for each shard that the shard tree is built from, and the most in all.
SHARD, POINTS, SAMPLE = 8_192, 48, 200_000
LEAF = 128
SPACE_RUN = re.compile(rb"[\x20\x09-\x0D]+")
SHINGLES_AT_ONCE = 1 << 16
SIGN = np.uint64(1 << 63)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is 1 if more than half of all shingle hashes have it set."""
    words = [w for w in SPACE_RUN.split(text.encode("utf-8", "replace").lower()) if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, SHINGLES_AT_ONCE):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[k:k + SHINGLES_AT_ONCE], last[k:k + SHINGLES_AT_ONCE])]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, code) for every row; the code is the fingerprint as a signed number. Null and empty texts have code 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = np.array([fingerprint(x or "", shingle) for x in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "code"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, code long")


@dataclass(frozen=True)
class ShardTree:
    """Inner nodes have a vantage point and a bound; a child below zero is the shard -1 - child."""

    point: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def visit(self, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of position in ``codes`` and shard whose region the ball of ``bits`` around the code may overlap."""
        if not len(self.point):
            return np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        rows, node = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        done_rows, done_shards = [], []
        while len(rows):
            distance = np.bitwise_count(codes[rows] ^ self.point[node]).astype(np.int64)
            to_left, to_right = distance - bits <= self.bound[node], distance + bits > self.bound[node]
            rows = np.concatenate([rows[to_left], rows[to_right]])
            node = np.concatenate([self.left[node[to_left]], self.right[node[to_right]]])
            ended = node < 0
            done_rows.append(rows[ended])
            done_shards.append(-1 - node[ended])
            rows, node = rows[~ended], node[~ended]
        return np.concatenate(done_rows), np.concatenate(done_shards)


def split_at(codes: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point, a bound and the distances; of a few candidates the one whose distances spread most widely.

    None if no candidate separates the codes.
    """
    best = None
    for k in np.linspace(0, len(codes) - 1, 5).astype(int):
        distance = np.bitwise_count(codes ^ codes[k]).astype(np.int64)
        bound = int(np.median(distance))
        if bound >= distance.max():
            bound = int(distance.max()) - 1
        if bound >= distance.min():
            near = np.abs(distance - bound).clip(max=3).sum()
            if best is None or near > best[0]:
                best = near, codes[k], bound, distance
    return None if best is None else best[1:]


def shard_tree(sample: np.ndarray, shards: int) -> ShardTree:
    """Splits the sample at medians of distances until about ``shards`` parts exist."""
    point, bound, left, right = [], [], [], []
    most = max(1, len(sample) // max(1, shards))
    count = 0

    def build(codes: np.ndarray) -> int:
        nonlocal count
        found = split_at(codes) if len(codes) > 1.5 * most else None
        if found is None:
            count += 1
            return -count
        here = len(point)
        point.append(found[0]), bound.append(found[1]), left.append(0), right.append(0)
        below = found[2] <= found[1]
        left[here], right[here] = build(codes[below]), build(codes[~below])
        return here

    build(sample)
    return ShardTree(np.array(point, dtype=np.uint64), np.array(bound, dtype=np.int64),
                     np.array(left, dtype=np.int64), np.array(right, dtype=np.int64))


def near_pairs(members: np.ndarray, queries: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (query, member) at most ``bits`` apart with the query smaller, through a tree in memory."""
    stack = [(members, queries)]
    while stack:
        own, asked = stack.pop()
        if not len(own) or not len(asked):
            continue
        found = split_at(own) if len(own) > LEAF else None
        if found is None:
            for start in range(0, len(asked), 4096):
                block = asked[start:start + 4096]
                for low in range(0, len(own), 1024):
                    rest = own[low:low + 1024]
                    q, m = np.nonzero(np.bitwise_count(block[:, None] ^ rest[None, :]) <= bits)
                    q, m = block[q], rest[m]
                    keep = q < m
                    if keep.any():
                        yield q[keep], m[keep]
            continue
        point, bound, distance = found
        far = np.bitwise_count(asked ^ point).astype(np.int64)
        stack.append((own[distance <= bound], asked[far - bits <= bound]))
        stack.append((own[distance > bound], asked[far + bits > bound]))


def linked_codes(codes: DataFrame, bits: int = 2, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(a, b) with a < b for all pairs of distinct codes at most ``bits`` apart; ``codes`` holds each code once.

    The driver receives ``POINTS`` codes for each shard, ``sample`` at most, chosen by hash, to place the vantage points; a
    single shard needs none. Every code is searched.
    """
    spark = codes.sparkSession
    total = codes.count()
    shards = -(-total // shard)
    wanted = min(sample, POINTS * shards) if shards > 1 else 0
    chosen = codes.filter(F.pmod(F.xxhash64("code"), F.lit(1 << 30)) < int((1 << 30) * wanted / max(total, 1)))
    points = np.array([r.code for r in chosen.orderBy(F.xxhash64("code")).limit(sample).collect()] if wanted else [], dtype=np.int64)
    fitted = shard_tree(points.view(np.uint64), shards)  # at most ``sample`` nodes
    shipped = spark.sparkContext.broadcast((fitted.point, fitted.bound, fitted.left, fitted.right))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = ShardTree(*shipped.value)
        for batch in batches:
            own = batch.column("code").to_numpy().view(np.uint64)
            for start in range(0, len(own), 4096):
                part = own[start:start + 4096]
                rows, shards = tree.visit(part, bits)
                order, home = tree.visit(part, 0)  # one shard for each code
                is_home = home[np.argsort(order)][rows] == shards
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards), pa.array(part[rows].view(np.int64)), pa.array(is_home)], ["shard", "code", "home"])

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        queries = frame["code"].to_numpy().view(np.uint64)
        found = list(near_pairs(queries[frame["home"].to_numpy()], queries, bits))
        a = np.concatenate([q for q, _ in found]) if found else np.zeros(0, dtype=np.uint64)
        b = np.concatenate([m for _, m in found]) if found else np.zeros(0, dtype=np.uint64)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = codes.select("code").mapInArrow(place, "shard long, code long, home boolean")
    return placed.groupBy("shard").applyInPandas(search, "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node of its component.

    Alternating rounds: every node hands the least node of its neighbourhood to its larger neighbours, then to its
    smaller ones, until nothing changes. Each round is written out, so a lost executor costs one round.
    """
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = cut_lineage(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .union(least.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text",
                    **limits) -> DataFrame:
    """(doc_id, code, component_id) for every row; the component is named by its smallest id.

    Texts without words have code 0 and link like any other. Rows that share an id are listed one by one. A null id
    gets the smallest id among its component, null if there is none. An empty table gives no rows.
    """
    prints = written(with_fingerprints(df, shingle, id_col, text_col), "fingerprints")
    codes = cut_lineage(prints.groupBy("code").agg(F.min("doc_id").alias("least")))
    roots = components(linked_codes(codes, bits, **limits))
    named = codes.join(roots, codes["code"] == roots["node"], "left").select(
        "code", "least", F.coalesce("root", "code").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    members = named.join(names, "root").select("code", "component_id")
    return prints.join(members, "code").select("doc_id", "code", "component_id")
