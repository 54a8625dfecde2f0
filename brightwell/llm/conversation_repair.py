"""Structure repair of conversations by the auction algorithm for shortest paths.

A conversation's rows are letters; an edit keeps (K), reroles (R) or deletes (D) a row or inserts (I) an empty one. Edits are
arcs of a lattice with one layer per row and one node per state of the grammar ``(s?(ua)+)?`` over role initials: nothing
yet, after s, after u, after a. The cheapest edits are a shortest path. The auction keeps a price for each node, never above
the cost of an arc plus the price of its head, and a path from the origin. At the path's end it either extends along the
least arc, ties by letter, or raises the price to that least value and contracts by a node. Prices start at the sum of what
each remaining row costs at least. Once the path reaches the sink, every arc of every cheapest path is tight (price equal
to cost plus price of the head), so following the least letter among tight arcs spells the least audit.

Rows are laid out once in global order and cut into blocks, so a conversation of any length is spread over tasks. Blocks of
a conversation that has several are first reduced to the cost from each state to each state; summed up backwards they give
the exact prices at the blocks' ends, with which every block is solved by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from brightwell.llm.batches import map_batches
from brightwell.llm.shared import written

#: Rows of a block.
BLOCK = 64
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs of edits; the last for a truncated row that stays
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a user or assistant turn is added in each state, and the cost to end in an accepted one.
NEXT = (USER, USER, ASSISTANT, USER)
CLOSING = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
#: A row's letter is a hexadecimal digit: 4 * kind of role (other, s, u, a) + fault.
FINE, CUT, BLANK, COPY = range(4)
OTHER = 0


def arcs_of(symbol: int, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, cost, layers ahead, state) of the arcs from a node, in order of letters."""
    kind, fault = divmod(symbol, 4)
    arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, NEXT[state])]
    if fault in (FINE, CUT):
        more = TRUNCATED if fault == CUT else 0
        if kind == SYSTEM and state == NOTHING or kind in ROLES and kind == NEXT[state]:
            arcs.append(("K", KEEP + more, 1, kind))
        arcs.append(("R", REROLE + more, 1, NEXT[state]))
    return tuple(arcs)


ARCS = [[arcs_of(symbol, state) for state in range(4)] for symbol in range(16)]
#: What a row costs at least, by its letter.
LEAST = [min(a[1] for state in range(4) for a in ARCS[symbol][state] if a[2]) for symbol in range(16)]


class Lattice:
    """One block with the prices of its nodes; ``ends`` are the costs from each state behind the last row to the sink."""

    def __init__(self, symbols: str, ends: tuple[int, ...]):
        self.rows = [int(c, 16) for c in symbols]
        self.ends = ends
        price = min(ends)
        self.prices = [[price] * 4]
        for symbol in reversed(self.rows):
            price += LEAST[symbol]
            self.prices.append([price] * 4)
        self.prices.reverse()

    def least_arc(self, layer: int, state: int) -> tuple[int, tuple | None]:
        """The least cost of an arc plus its head's price, and the first such arc by letter; None stands for the sink."""
        if layer == len(self.rows):
            return self.ends[state], None
        best, chosen = FAR, None
        for arc in ARCS[self.rows[layer]][state]:
            value = arc[1] + self.prices[layer + arc[2]][arc[3]]
            if value < best:
                best, chosen = value, arc
        return best, chosen

    def auction(self, entry: int) -> int:
        """Runs the auction from the first layer's ``entry`` and returns the cost of the cheapest path."""
        path = [(0, entry)]
        while True:
            layer, state = path[-1]
            value, arc = self.least_arc(layer, state)
            if self.prices[layer][state] < value:
                self.prices[layer][state] = value
                if len(path) > 1:
                    path.pop()
            elif layer == len(self.rows):
                return self.prices[0][entry]
            else:
                path.append((layer + arc[2], arc[3]))

    def trace(self, entry: int) -> tuple[str, int]:
        """The least audit among tight arcs, and the state it ends in; ``auction`` has run from ``entry``."""
        letters, layer, state = [], 0, entry
        while layer < len(self.rows):
            letter, _, ahead, head = next(arc for arc in ARCS[self.rows[layer]][state] if arc[1] + self.prices[
                layer + arc[2]][arc[3]] == self.prices[layer][state])
            letters.append(letter)
            layer, state = layer + ahead, head
        return "".join(letters), state


@lru_cache(maxsize=50_000)
def solved(symbols: str, ends: tuple[int, ...], entry: int) -> tuple[int, str, int]:
    """(cost up to the block's end, audit, state at the end) of the cheapest edits of a block."""
    lattice = Lattice(symbols, ends)
    cost = lattice.auction(entry)
    audit, state = lattice.trace(entry)
    return cost - ends[state], audit, state


def transfer(symbols: str) -> list[int]:
    """The least cost of a block from each state to each state, 16 numbers row by row; ``FAR`` where there is no way."""
    out = [[FAR] * 4 for _ in range(4)]
    for state in (USER, ASSISTANT):
        lattice = Lattice(symbols, tuple(0 if s == state else FAR for s in range(4)))
        for entry in range(4):
            out[entry][state] = lattice.auction(entry)
    # Nothing leads back to the first two states: only deletions stay there, and one kept system row leads on.
    out[NOTHING][NOTHING] = out[SYSTEM][SYSTEM] = DELETE * len(symbols)
    kept = [TRUNCATED if s % 4 == CUT else 0 for s in (int(c, 16) for c in symbols) if s // 4 == SYSTEM and s % 4 in (FINE, CUT)]
    if kept:
        out[NOTHING][SYSTEM] = DELETE * (len(symbols) - 1) + KEEP + min(kept)
    return [x for row in out for x in row]


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by crc32 of ``conv_id:turn`` modulo 20, for trying out the repair.

    0 drops a row, 1 empties its text, 2 takes out ``[.!?]``, 3 repeats it, 4 makes it a user's. A null counts as a space.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col))) % 20
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"),
                     filled(text_col).alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), copies.alias("copy")).drop("copy")


def with_letters(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text, copy, letter) for every row; ``copy`` counts equal rows.

    The first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated. Equal rows are
    counted first, so that many of them travel as one.
    """
    text = F.coalesce(F.col(text_col), F.lit(" "))
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows.withColumn("said", F.sha2(
        F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "conversation-rows")
    first = rows.groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns"))
    again = first.filter("turns > 1").select(F.col("conv_id").alias("own_id"), F.col("said").alias("own_said"), "first")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("own_id")) & (F.col("said") == F.col("own_said")), "left")
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (F.when(end == "", BLANK)
             .when((F.col("copy") > 0) | F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)), COPY)
             .when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("conv_id", "turn", "role", "text", "copy", F.lower(F.hex(4 * kind + fault)).alias("letter"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """(conv_id, block, symbols, turns, roles, texts): up to ``BLOCK`` neighbouring rows of a conversation, written out.

    Rows stand by turn, nulls first, then by role and text. Blocks of a conversation are numbered upwards.
    """
    order = ["conv_id", "turn", "role", "text", "copy"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        out: list[dict] = []

        def close() -> None:
            nonlocal number, held
            if held:
                out.append({"conv_id": held[0]["conv_id"], "block": number, "symbols": "".join(r["letter"] for r in held),
                            **{f"{c}s": [r[c] for r in held] for c in ("turn", "role", "text")}})
                number, held = number + 1, []

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["conv_id"] != held[0]["conv_id"] or len(held) == BLOCK):
                    close()
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema({"conv_id": pa.int64(), "block": pa.int64(), "symbols": pa.string(), "turns": pa.list_(pa.int64()),
                        "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())})
    return written(map_batches(laid, cut, "conv_id long, block long, symbols string, turns array<long>, "
                                          "roles array<string>, texts array<string>"), "conversation-blocks")


def ends_and_entries(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, ends, entry, last) for the blocks of conversations that have several.

    ``ends`` are the prices behind the block, ``entry`` is the state it starts in. What one task holds of a conversation
    is 16 numbers, then four states, for each block.
    """
    slim = blocks.select("conv_id", "block", "symbols")
    counted = slim.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("conv_id").alias("own_id"))
    several = slim.join(counted, F.col("conv_id").eqNullSafe(F.col("own_id")), "left_semi")

    @F.pandas_udf("array<long>")
    def costs(symbols: pd.Series) -> pd.Series:
        return symbols.map(transfer)

    def backwards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block", ascending=False)
        ends, out = np.array(CLOSING, dtype=np.int64), []
        for matrix in group["costs"]:
            out.append(ends.tolist())
            ends = np.minimum(np.min(np.array(matrix, dtype=np.int64).reshape(4, 4) + ends, axis=1), FAR)
        return pd.DataFrame({"conv_id": group["conv_id"], "block": group["block"], "symbols": group["symbols"], "ends": out})

    @F.pandas_udf("array<int>")
    def exits(symbols: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([[solved(s, tuple(map(int, e)), entry)[2] for entry in range(4)] for s, e in zip(symbols, ends)])

    def forwards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        state, entries = NOTHING, []
        for ways in group["exits"]:
            entries.append(state)
            state = int(ways[state])
        last = [False] * (len(group) - 1) + [True]
        return pd.DataFrame({"conv_id": group["conv_id"], "block": group["block"], "ends": group["ends"], "entry": entries,
                             "last": last})

    priced = several.withColumn("costs", costs("symbols")).groupBy("conv_id").applyInPandas(
        backwards, "conv_id long, block long, symbols string, ends array<long>")
    passed = written(priced, "block-prices").withColumn("exits", exits("symbols", "ends")).drop("symbols")
    return passed.groupBy("conv_id").applyInPandas(forwards, "conv_id long, block long, ends array<long>, entry int, last boolean")


REPAIRED = ("conv_id long, block long, audit string, cost long, roles array<string>, texts array<string>, faults array<long>, "
            "kinds string, turns array<long>")


def repaired_blocks(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """The cheapest repair of every conversation, one row per block of up to ``BLOCK`` input rows, written out.

    ``audit`` and ``cost`` are those of the block's edits, ``roles`` and ``texts`` the turns that result; ``faults`` counts
    blank, duplicate and truncated rows, ``kinds`` are the kinds of the input rows' roles and ``turns`` their numbers.
    Null roles and texts count as a space, null turns come first, equal turns stand by role and text. Rows without a
    conversation id are one conversation. Empty texts are blank; an empty table gives no rows.
    """
    blocks = blocks_of(with_letters(df, conv_col, turn_col, role_col, text_col))
    found = ends_and_entries(blocks).withColumnsRenamed({"conv_id": "own_id", "block": "own_block"})
    both = blocks.join(found, F.col("conv_id").eqNullSafe(F.col("own_id")) & (F.col("block") == F.col("own_block")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [apply(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    def apply(row: dict) -> dict:
        ends = CLOSING if row["ends"] is None else tuple(row["ends"])
        cost, audit, state = solved(row["symbols"], ends, row["entry"] or NOTHING)
        if row["last"] is not False:
            more = {SYSTEM: 2, USER: 1}.get(state, 0)
            cost, audit = cost + more * INSERT, audit + "I" * more
        turns = edited(audit, row["entry"] or NOTHING, row["roles"], row["texts"])
        faults = [int(c, 16) % 4 for c in row["symbols"]]
        return {"conv_id": row["conv_id"], "block": row["block"], "audit": audit, "cost": cost,
                "roles": [r for r, _ in turns], "texts": [t for _, t in turns],
                "faults": [faults.count(f) for f in (BLANK, COPY, CUT)],
                "kinds": "".join("xsua"[int(c, 16) // 4] for c in row["symbols"]), "turns": row["turns"]}

    schema = pa.schema({"conv_id": pa.int64(), "block": pa.int64(), "audit": pa.string(), "cost": pa.int64(),
                        "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "faults": pa.list_(pa.int64()),
                        "kinds": pa.string(), "turns": pa.list_(pa.int64())})
    return written(map_batches(both.select(*blocks.columns, "ends", "entry", "last"), run, REPAIRED), "repaired-blocks")


def edited(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that an audit makes of a block's rows, from a state on."""
    turns, rows = [], iter(zip(roles, texts))
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        else:
            state = NEXT[state]
            role = ROLES[state]
        turns.append((role, text))
    return turns


def repaired_turns(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, place, role, text): the turns of repaired conversations; block, then place, gives their order."""
    return blocks.select("conv_id", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")).select(
        "conv_id", "block", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def summaries(blocks: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every repaired conversation.

    A conversation's blocks are read in order in one task, a block at a time; only its audit is kept. ``gaps`` counts turn
    numbers missing between the least and the largest, ``illegal`` neighbouring role initials other than su, ua and au.
    """
    laid = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Summary | None = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now.conv_id:
                    if now:
                        out.append(now.row())
                    now = Summary(row["conv_id"])
                now.add(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([*((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return map_batches(laid, run, ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string")


class Summary:
    """What is known of a conversation after the blocks read so far."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.kind, self.first, self.last, self.distinct = conv_id, "", None, None, 0
        self.faults, self.illegal, self.cost, self.audit = [0, 0, 0], 0, 0, []
        self.digest, self.started = hashlib.sha256(), False

    def add(self, row: dict) -> None:
        for turn in row["turns"]:
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.distinct = turn, self.distinct + 1
        kinds = self.kind + row["kinds"]
        self.illegal += sum(kinds[k:k + 2] not in ("su", "ua", "au") for k in range(len(kinds) - 1))
        self.kind = kinds[-1]
        self.faults = [a + b for a, b in zip(self.faults, row["faults"])]
        self.cost += row["cost"]
        self.audit.append(row["audit"])
        for role, text in zip(row["roles"], row["texts"]):
            self.digest.update(f"{chr(10) if self.started else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.started = True

    def row(self) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        blank, duplicate, truncated = self.faults
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated,
                "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit),
                "repaired_sha256": self.digest.hexdigest()}


def of_every_conversation(found: DataFrame, originals: DataFrame) -> DataFrame:
    """``summaries`` with a row for each id of ``originals`` (conv_id): zeros and empty texts where no row is left."""
    ids = originals.select(F.col("conv_id").cast("long").alias("own_id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts]
    return ids.join(found, F.col("own_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("own_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
