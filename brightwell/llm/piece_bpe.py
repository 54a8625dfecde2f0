"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The library is asked for the vocabulary and its scores only. A text is cut before each run of blanks; no piece crosses
such a cut, so words are encoded on their own and each distinct word once. Many words go through the merges together: a
flat array of symbols, the rank of every neighbouring pair, per round the least rank of each word, all leftmost merges
of that rank at once, and compaction, until no word has a pair left. In a long word a pair is merged as soon as none within
the length of the longest piece ranks before it: a merge further away cannot reach it, as no piece spans the distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from sentencepiece import SentencePieceProcessor

from brightwell.llm.batches import Spelled, lists, map_batches, pieces, spread, texts_of, worker_state

BLANK = "▁"
NO_PAIR = np.iinfo(np.int32).max


class PieceNames:
    """The pieces of a vocabulary as text, which is all that decoding needs."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = model.id_to_piece(list(range(size)))
        self.unknown = model.unk_id()
        self.names = names
        self.byte_of = {k: int(names[k][3:5], 16) for k in range(size) if model.is_byte(k)}
        self.silent = frozenset(k for k in range(size) if model.is_control(k))
        special = {k for k in range(size) if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)}
        # Bytes below 128 are characters on their own, so ids of this set spell a text one by one.
        self.shown = [chr(self.byte_of[k]) if self.byte_of.get(k, 128) < 128 else name for k, name in enumerate(names)]
        self.plain = frozenset(k for k in range(size) if k not in special or self.byte_of.get(k, 128) < 128)
        self._more(model, special)

    def _more(self, model: SentencePieceProcessor, special: set[int]) -> None:
        """What a table for encoding reads from the model besides."""

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: byte pieces join to characters, a broken byte becomes U+FFFD, the leading blank goes."""
        if not ids:
            return ""
        if self.plain.issuperset(ids):
            text = "".join(map(self.shown.__getitem__, ids))
            return (text[1:] if self.names[ids[0]][0] == BLANK else text).replace(BLANK, " ")
        out: list[str] = []
        pending = bytearray()
        first = True
        for k in ids:
            byte = self.byte_of.get(k)
            if byte is not None:
                pending.append(byte)
                first = False
                continue
            if pending:
                out.append(_utf8(pending))
                pending.clear()
            if k in self.silent:
                continue
            if k == self.unknown:
                out.append(" ⁇ ")
            else:
                name = self.names[k]
                out.append((name[1:] if first and name[0] == BLANK else name).replace(BLANK, " "))
            first = False
        if pending:
            out.append(_utf8(pending))
        return "".join(out)


class PieceTable(PieceNames):
    """Vocabulary of a BPE model with byte fallback as arrays; symbols are piece ids."""

    def _more(self, model: SentencePieceProcessor, special: set[int]) -> None:
        names, size = self.names, len(self.names)
        scores = np.array(model.get_score(list(range(size))))
        self.byte_ids = np.full(256, self.unknown, dtype=np.int32)
        for k, byte in self.byte_of.items():
            self.byte_ids[byte] = k
        known = {name: k for k, name in enumerate(names) if k not in special}
        if any(BLANK in name.lstrip(BLANK) for name in known):
            raise ValueError("a piece of this vocabulary holds a blank after another character")
        # Characters in order of code point; a character outside the vocabulary is a symbol of its own, -1 - code point.
        singles = sorted((ord(name), k) for name, k in known.items() if len(name) == 1)
        self.chars = np.array([c for c, _ in singles], dtype=np.int64)
        self.char_ids = np.array([k for _, k in singles], dtype=np.int64)
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        pairs = sorted((known[name[:cut]] * size + known[name[cut:]], k) for name, k in known.items()
                       for cut in range(1, len(name)) if name[:cut] in known and name[cut:] in known)
        self.size = size
        self.reach = max(map(len, known), default=1)
        self.keys = np.array([x for x, _ in pairs] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.merged = np.array([k for _, k in pairs] + [-1], dtype=np.int64)
        self.ranks = np.append(rank[self.merged[:-1]], NO_PAIR)
        # After such a merge a pair with the new symbol may come before the remaining pairs of the same rank; then only
        # the first pair of a word may be merged in one round. The same holds where different pieces share a rank.
        self.single = np.zeros(size + 1, dtype=bool)
        left, right, result = self.keys[:-1] // size, self.keys[:-1] % size, self.merged[:-1]
        for part in (left, right):
            self.single[part[rank[result] <= rank[part]]] = True
        shared = np.bincount(rank[list(known.values())], minlength=len(rank)) > 1
        self.single[:size] |= shared[rank]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each neighbouring pair; NO_PAIR where the vocabulary lacks it."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_PAIR), np.where(hit, self.merged[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that start with their blanks: flat ids and their number per word. No word may be empty."""
        data = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = np.minimum(np.searchsorted(self.chars, data), len(self.chars) - 1)
        symbol = np.where(self.chars[at] == data, self.char_ids[at], -1 - data)
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        inside = np.append(word[1:] == word[:-1], False)
        rank, into = np.full(len(symbol), NO_PAIR), np.full(len(symbol), -1)
        rank[inside], into[inside] = self.pair(symbol[:-1][inside[:-1]], symbol[1:][inside[:-1]])
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            finished = least == NO_PAIR
            if finished.any():
                done_symbols.append(symbol[finished])
                done_words.append(word[finished])
                stay = ~finished
                symbol, word, rank, into, least = symbol[stay], word[stay], rank[stay], into[stay], least[stay]
                if not len(symbol):
                    break
            long = np.repeat(lengths > 4 * self.reach, lengths)[~finished] if finished.any() else np.repeat(
                lengths > 4 * self.reach, lengths)
            before = np.full(len(rank), NO_PAIR)  # the least rank close by on the left, where that matters
            if long.any():
                least, before = least.copy(), before
                least[long], before[long] = nearest(rank[long], self.reach)
            hits = np.flatnonzero((rank == least) & (rank != NO_PAIR))
            # Of overlapping pairs every other one counts, from the left: the parity within a run of neighbours decides.
            fresh = np.append(True, np.diff(hits) > 1)
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            chosen = (np.arange(len(hits)) - run_start) % 2 == 0
            # In a long word such a run may begin further left with a pair that is not due yet; then all of it waits.
            begin = hits[run_start]
            chosen &= ~(long[hits] & (begin > 0) & (rank[begin - 1] == rank[begin]))
            first = np.append(True, word[hits[1:]] != word[hits[:-1]])
            cautious = np.zeros(len(words), dtype=bool)
            cautious[word[hits[self.single[into[hits]]]]] = True
            chosen = np.where(~long[hits] & cautious[word[hits]], first, chosen)
            chosen = np.where(long[hits] & self.single[into[hits]], before[hits] > rank[hits], chosen)
            hits = hits[chosen]
            symbol[hits] = into[hits]
            stay = np.ones(len(symbol), dtype=bool)
            stay[hits + 1] = False
            place = np.cumsum(stay) - 1
            symbol, word, rank, into = symbol[stay], word[stay], rank[stay], into[stay]
            changed = place[hits]
            changed = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
            follows = changed + 1 < len(symbol)
            inner = changed[follows][word[changed[follows] + 1] == word[changed[follows]]]
            rank[changed], into[changed] = NO_PAIR, -1
            rank[inner], into[inner] = self.pair(symbol[inner], symbol[inner + 1])
        if not done_symbols:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return self._with_bytes(symbol[order], word[order], len(words))

    def _with_bytes(self, symbol: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become the ids of their UTF-8 bytes."""
        outside = symbol < 0
        if not outside.any():
            return symbol.astype(np.int32), np.bincount(word, minlength=words)
        codes, which = np.unique(-1 - symbol[outside], return_inverse=True)
        spelled = [self.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in codes]
        sizes = np.fromiter(map(len, spelled), dtype=np.int64)
        flat, begins = np.concatenate(spelled), np.cumsum(sizes) - sizes
        each = np.ones(len(symbol), dtype=np.int64)
        each[outside] = sizes[which]
        out = np.repeat(symbol, each)
        out[np.repeat(outside, each)] = flat[spread(begins[which], sizes[which])]
        return out.astype(np.int32), np.bincount(np.repeat(word, each), minlength=words)


def nearest(rank: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place the least rank up to ``reach`` places away, itself included, and the least of those to its left."""
    edge = np.full(reach, NO_PAIR)
    values, size = np.concatenate([edge, rank, edge]), 1
    while 2 * size <= reach:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    if size < reach:
        values = np.minimum(values[:len(values) - (reach - size)], values[reach - size:])
    # values[i] is now the least of the ``reach`` places that begin at place i - reach.
    left, right = values[:len(rank)], values[reach + 1:reach + 1 + len(rank)]
    return np.minimum(np.minimum(left, right), rank), left


def _utf8(data: bytearray) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, k = [], 0
    while k < len(data):  # one replacement for each byte that starts no character
        for size in (1, 2, 3, 4):
            try:
                out.append(data[k:k + size].decode("utf-8"))
                k += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


class PieceEncoder:
    """Whole texts by their distinct words."""

    def __init__(self, path: str):
        self.table = PieceTable(path)
        self.words = Spelled(self._spell)

    def _spell(self, words: list[str]) -> list[bytes]:
        ids, sizes = self.table.encode_words([BLANK + w for w in words])
        data, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; an empty text has none."""
        return self.words.joined([words_of(x) for x in texts])


def words_of(text: str) -> list[str]:
    """Words without the first of their blanks; the text gets a blank in front, further blanks lead the next word."""
    if not text:
        return []
    text = text.replace(BLANK, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    out, blanks = [], ""
    for word in words[:-1]:
        if word:
            out.append(blanks + word)
            blanks = ""
        else:
            blanks += BLANK
    return [*out, blanks + words[-1]]


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row and its whole text, without begin or end ids; a null or empty text has no ids.

    Rows that repeat or share an id are encoded one by one; an empty table gives no rows. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"pieces {model_path}", lambda: PieceEncoder(model_path))
        for part in pieces(batches, "text"):
            data = encoder.encode(texts_of(part, "text"))
            sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 4
            ids = lists(np.frombuffer(b"".join(data), dtype="<i4"), sizes, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, ids array<int>")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) for every row; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_state(f"names {model_path}", lambda: PieceNames(model_path))
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [table.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, type=pa.string())],
                                                 ["doc_id", "ids", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_batches(rows, run, "doc_id long, ids array<int>, text string")


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, text) for every row: ``encode`` and ``decode`` in one pass, with one table in a worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"pieces {model_path}", lambda: PieceEncoder(model_path))
        for part in pieces(batches, "text"):
            data = [np.frombuffer(x, dtype="<i4") for x in encoder.encode(texts_of(part, "text"))]
            sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
            texts = pa.array([encoder.table.decode(x.tolist()) for x in data], type=pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists(np.concatenate(data), sizes, pa.int32()), texts],
                                             ["doc_id", "ids", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, ids array<int>, text string")


def round_trip_digests(df: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    return round_trip(df, model_path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"))
