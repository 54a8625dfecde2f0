import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pathlib import Path
from tokenizers import Tokenizer

from brightwell.llm.batches import Numbered, Spelled, pieces, spread
from brightwell.llm.token_store import SegmentEncoder, Segments, read_tokens, token_digests, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", " ", "a", "a  b", " x\n\n y 's  don't\t a \n<|endoftext|> b <|endoftext|>", "a  b　 c", "\x1c a\x85 b  ",
         "Éa zwölf 12,5 \U0001F600 한국", "no_blank" * 300, "word " * 500 + "end", "we're they'll 's 'd"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_segments_give_the_ids_of_whole_texts():
    random.seed(5)
    texts = TEXTS + ["".join(random.choice(" \n\t.'sabé1\x85<|>") for _ in range(random.randint(0, 60))) for _ in range(3000)]
    found = SegmentEncoder(PATH).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [ids(t) for t in texts]


def test_columns_give_the_same_ids():
    random.seed(6)
    texts = TEXTS + ["x" * 3000 + " y" * 50, "a.\nb c.\nd" * 40] + ["".join(random.choice(" \n.'sabé1<|>") for _ in range(random.randint(0, 80)))
                                                               for _ in range(1500)]
    flat, sizes = SegmentEncoder(PATH).encode_column(texts)
    ends = np.cumsum(sizes)
    assert [flat[a:b].tolist() for a, b in zip(ends - sizes, ends)] == [ids(t) for t in texts]


def test_other_tokenizers_are_asked_for_whole_texts(folder):
    import json

    from tokenizers import pre_tokenizers

    digits = Tokenizer.from_file(PATH)
    digits.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    digits.save(f"{folder}/digits.json")
    lower = json.loads(LIBRARY.to_str()) | {"normalizer": {"type": "Lowercase"}}
    open(f"{folder}/lower.json", "w").write(json.dumps(lower))
    texts = ["In 2024 there were 12345 words", "A b\n  C", "", None or ""]
    for path in (f"{folder}/digits.json", f"{folder}/lower.json", public_tokenizers.path("word_bpe_49k.json")):
        library, encoder = Tokenizer.from_file(path), SegmentEncoder(path)
        flat, sizes = encoder.encode_column(texts)
        assert not encoder.cuts and np.split(flat, np.cumsum(sizes)[:-1])[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids
        assert flat.tolist() == [k for t in texts for k in library.encode(t, add_special_tokens=False).ids]
    assert SegmentEncoder(PATH).cuts


def test_long_segments_are_not_kept():
    encoder = SegmentEncoder(PATH)
    encoder.encode_column(["a " + "x1" * 400 + " b\nc d"])
    assert all(len(w) <= 32 and "\n" not in w[1:] for w in encoder.segments)


def test_store_reads_back_in_order(spark, folder):
    rows = [(k * 3 % 97, t, "x", k) for k, t in enumerate(TEXTS)] + [(500, None, None, None), (501, "last", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string, shard int").repartition(3)
    write_tokens(df, folder + "/s", PATH)
    got = {r.doc_id: r for r in token_digests(read_tokens(spark, folder + "/s")).collect()}
    start = 0
    for doc_id, text in sorted((r[0], r[1]) for r in rows):
        own = ids(text) + [0]
        r = got[doc_id]
        assert (r.start, r.n_tokens) == (start, len(own))
        assert r.ids_crc32 == zlib.crc32(np.asarray(own, "<u4").tobytes())
        start += len(own)
    some = read_tokens(spark, folder + "/s", first=10, last=60)
    assert {r.doc_id for r in some.collect()} == {k for k in got if 10 <= k <= 60}
    assert "tokens" not in read_tokens(spark, folder + "/s", with_tokens=False).columns


def test_files_have_the_stated_encodings_and_indexes(spark, folder):
    df = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 20) AS text").coalesce(1)
    write_tokens(df, folder + "/s", PATH, row_group_bytes=1 << 14, page_bytes=1 << 12)
    files = sorted(Path(folder, "s/tokens").glob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > 1
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["local_start"].encodings
    assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
    assert all(c.has_column_index and c.has_offset_index for k, c in columns.items() if k != "tokens.list.element")
    plan = read_tokens(spark, folder + "/s", first=5, last=9, with_tokens=False)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "tokens:array" not in plan.split("ReadSchema")[1]


def test_repeated_null_and_missing_rows(spark, folder):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "x"), (1, "a")], "doc_id long, text string")
    write_tokens(df, folder + "/s", PATH)
    rows = read_tokens(spark, folder + "/s").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1]
    assert [list(r.tokens) for r in rows] == [ids(t) + [0] for t in ("x", "a", "a", "b")]
    write_tokens(df.limit(0), folder + "/e", PATH)
    assert token_digests(read_tokens(spark, folder + "/e")).count() == 0


def test_word_tables():
    table = Numbered(lambda ws: (np.array([len(w) for w in ws]),), limit=3)
    for words in (["a", "bb", "a"], ["ccc", "dddd", "bb"], ["a"] * 5):
        at = table.numbers(words)
        assert table.columns[0][at].tolist() == [len(w) for w in words]
    kept = Spelled(lambda ws: [w.encode() for w in ws], limit=2)
    for texts in ([["a", "b", "c", "a"], []], [["d"]], [["a", "e"], ["d", "d"]], [["b"]]):
        assert kept.joined(texts) == ["".join(words).encode() for words in texts]
    assert spread(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_pieces_cover_all_rows():
    import pyarrow as pa

    texts = ["x" * n for n in (0, 5, 100, 3, 3, 3, 250, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = list(pieces([batch], "t", 10))
    assert [x for p in parts for x in p.column("t").to_pylist()] == texts and len(parts) > 3


def test_segments_are_spelt_once_per_generation():
    asked = []
    table = Segments(lambda w: asked.append(w) or w.encode(), limit=2)
    for words in (["a", "b", "c"], ["a"], ["d", "a"], ["b", "a"], ["b", "c"]):
        table.turn()
        assert [table[w] for w in words] == [w.encode() for w in words]
    assert asked.count("a") == 1 and len(table) + len(table.older) <= 7
