"""Token ids as Parquet list columns that can be read in part.

One row holds one document: its id, the file it lies in (``shard``), the ids before it in that file (``local_start``),
their number and the ids as a list. Documents lie in ascending order of id. The id and offset columns are delta encoded
(ascending numbers, no dictionary), the ids use a dictionary while it pays and delta encoding beyond; row groups and
pages have a fixed size, and the column and offset indexes that Spark's writer adds let a reader fetch the pages of a
range of documents or of the metadata alone. A small manifest gives the ids before each file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from brightwell.llm.batches import BATCH_BYTES, lists, map_batches, pieces, spread, texts_of, worker_state

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Segments and parts that a worker keeps, twice over, and the characters of the longest that is kept.
KEPT_SEGMENTS, KEPT_CHARS = 300_000, 32
#: Marks behind words.
MARKS = frozenset(".,")
STORED = "doc_id long, shard int, local_start long, n_tokens int, tokens array<int>"


#: The splitting pattern of the byte-level vocabulary, white space besides blank and line feed, and the
#: bytes that stand for themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RARE_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a" \
    "\u2028\u2029\u202f\u205f\u3000"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: What a tokenizer file must say for texts to be cut at blanks.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_BPE = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
             "byte_fallback": False}


class Segments(dict):
    """Ids of segments, spelt when first asked for.

    Two generations of about ``limit`` short ones are kept, so memory is bounded in bytes too: longer segments, those that
    span lines and so hardly ever come again, and words with a mark behind them are put together each time.
    """

    def __init__(self, spell: Callable[[str], bytes], limit: int = KEPT_SEGMENTS):
        super().__init__()
        self.spell, self.limit, self.older = spell, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.spell(word)
            if len(word) > KEPT_CHARS or word[-1:] in MARKS or "\n" in word[1:]:
                return ids
        self[word] = ids
        return ids

    def turn(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


class SegmentEncoder:
    """Ids of whole texts by the tokenizers library, whose model is asked once for each distinct part of a word.

    A segment is a run without blanks together with the single blank before it. The vocabulary's splitting pattern
    never joins characters across such a blank, so the ids of a text are those of its segments, one after another.
    Texts with other white space next to a blank are cut only where a blank stands alone. Segments that hold a special
    token, and the first of each text, go through the library's whole encoding. Where the tokenizer's file names another
    normalizer, splitting or model, nothing is cut and every text goes to the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cuts = cuts_at_blanks(json.loads(self.tokenizer.to_str()))
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        others = iter(range(256, 512))
        self.spelling = {b: chr(b) if b in PRINTED else chr(next(others)) for b in range(256)}
        self.little = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.split = regex.compile(PATTERN)
        self.lone = re.compile(r"(?<=\S) (?=\S)")
        self.runs = re.compile(r"\s\s")
        self.blank = self.spelling[32]
        self.parts = Segments(self._spelt_part)
        self.marks = {mark: self._spelt_part(mark) for mark in MARKS}
        self.segments = Segments(self._segment)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _spelt_part(self, part: str) -> bytes:
        little = self.little
        if not part.isalpha() or not part.isascii() and part[0] != self.blank:
            part = part.encode("utf-8").decode("latin-1").translate(self.spelling)
        return b"".join([little[t.id] for t in self.model.tokenize(part)])

    def _segment(self, word: str) -> bytes:
        """Ids of a segment, given without its blank. Most are a word, or a word and a mark, which are parted at once."""
        if word.isalpha():
            return self._spelt_part(self.blank + word if word.isascii() else " " + word)
        if word[-1:] in self.marks and word[:-1].isalpha():
            return self.segments[word[:-1]] + self.marks[word[-1]]
        if self.special.search(word):
            return self._whole(" " + word)
        return b"".join(map(self.parts.__getitem__, self.split.findall(" " + word)))

    def irregular(self, text: str) -> bool:
        """Whether a blank stands at an end of the text or next to other white space."""
        if text[:1].isspace() or text[-1:].isspace() or "  " in text or " \n" in text or "\n " in text:
            return True
        return any(c in text for c in RARE_SPACE) and self.runs.search(text) is not None

    def encode_column(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their number per text. Words are told apart in Arrow, and each is spelt once."""
        regular = [self.cuts and not self.irregular(x) for x in texts]
        split = pc.split_pattern(pa.array([x if own else "" for x, own in zip(texts, regular)], type=pa.string()), " ")
        ends = np.cumsum(split.value_lengths().to_numpy())
        flat, first = split.flatten(), np.concatenate([[0], ends[:-1]]).astype(np.int64)
        inner = np.ones(len(flat), dtype=bool)
        inner[first] = False
        coded = flat.filter(pa.array(inner)).dictionary_encode()
        self.segments.turn()
        self.parts.turn()
        spelt = list(map(self.segments.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        words = len(spelt)
        for text, own, head in zip(texts, regular, flat.take(pa.array(first)).to_pylist()):
            spelt.append(self.encode([text])[0] if not own else self.parts[head] if head.isalpha() else self._whole(head))
        which = np.empty(len(flat), dtype=np.int64)
        which[inner], which[first] = coded.indices.to_numpy(), words + np.arange(len(texts))
        sizes = np.fromiter(map(len, spelt), dtype=np.int64, count=len(spelt)) // 4
        starts, each = np.cumsum(sizes) - sizes, sizes[which]
        ids = np.frombuffer(b"".join(spelt), dtype="<i4")[spread(starts[which], each)]
        return ids, np.add.reduceat(each, first)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.cuts:
            return list(map(self._whole, texts))
        parts = [self.lone.split(x) if self.irregular(x) else x.split(" ") for x in texts]
        heads = [p.pop(0) for p in parts]
        heads = [self.parts[x] if x.isalpha() else self._whole(x) for x in heads]
        self.segments.turn()
        self.parts.turn()
        known = self.segments.__getitem__
        return [head + b"".join(map(known, p)) for head, p in zip(heads, parts)]


def cuts_at_blanks(stated: dict) -> bool:
    """Whether a tokenizer file states the splitting that segments rely on."""
    holds = lambda part, fixed: isinstance(part, dict) and all(part.get(k) == v for k, v in fixed.items())
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in stated["added_tokens"])
    return stated["normalizer"] is None and plain and not stated.get("truncation") and holds(
        stated["pre_tokenizer"], BYTE_LEVEL) and holds(stated["model"], PLAIN_BPE) and not stated["model"].get("ignore_merges")


def write_tokens(df: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 0, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Encodes every text, appends ``end_id`` and stores the ids in ascending order of ``id_col``.

    Null texts are empty: they store the end id alone. Rows that share an id are stored one after another in order of
    their text; a null id comes first. An empty table gives an empty store. Other columns of ``df`` are not read.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"segments {tokenizer_path}", lambda: SegmentEncoder(tokenizer_path))
        shard, start = TaskContext.get().partitionId(), 0
        for part in pieces(batches, "text", BATCH_BYTES):
            ids, sizes = encoder.encode_column(texts_of(part, "text"))
            ends = np.cumsum(sizes)
            ids, sizes = np.insert(ids, ends, end_id), sizes + 1
            ends = start + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.full(len(sizes), shard, dtype=np.int32)), pa.array(ends - sizes),
                 pa.array(sizes.astype(np.int32)), lists(ids, sizes, pa.int32())],
                ["doc_id", "shard", "local_start", "n_tokens", "tokens"])
            start = int(ends[-1])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (map_batches(rows, encode, STORED).write
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#local_start", "false")
     .option("compression", "zstd").parquet(f"{folder}/tokens"))
    spark = df.sparkSession
    files = (spark.read.parquet(f"{folder}/tokens").groupBy("shard")
             .agg(F.sum("n_tokens").alias("shard_tokens"), F.count(F.lit(1)).alias("shard_documents")))
    before = F.coalesce(F.sum("shard_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0).cast("long"))
    files.withColumn("shard_start", before).coalesce(1).write.parquet(f"{folder}/manifest")  # one row for each file


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None,
                with_tokens: bool = True) -> DataFrame:
    """Stored documents with ``start``, the ids of all documents before.

    ``first`` and ``last`` bound the ids and reach the scan, which skips row groups and pages by their indexes; without
    ``with_tokens`` the column of ids is not read.
    """
    rows = spark.read.schema(STORED).parquet(f"{folder}/tokens")
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    if not with_tokens:
        rows = rows.drop("tokens")
    files = spark.read.parquet(f"{folder}/manifest").select("shard", "shard_start")
    rows = rows.join(files, "shard").withColumn("start", F.col("shard_start") + F.col("local_start"))
    return rows.drop("shard", "shard_start", "local_start")


def token_digests(rows: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (crc32 of the ids as little-endian unsigned 32-bit numbers)."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            offsets = np.asarray(tokens.offsets)
            values = np.asarray(tokens.values, dtype="<i4").view(np.uint8)
            sums = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens").cast(pa.int64()),
                 pa.array(sums, type=pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows.select("doc_id", "start", "n_tokens", "tokens"), digest,
                       "doc_id long, start long, n_tokens long, ids_crc32 long")
