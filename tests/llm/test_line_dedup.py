import random

import numpy as np

from brightwell.llm.line_dedup import BLANKS, Bloom, without_repeated_lines
from brightwell.llm.queries import op4_line_dedup

SPACE = BLANKS.decode()


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(SPACE).translate(low)
    holders = {}
    for doc_id, text in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(key(x)) < 10 or min(holders[key(x)]) == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def result(df, **options):
    return sorted(map(tuple, without_repeated_lines(df, **options).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


def test_against_brute_force(spark):
    random.seed(4)
    pool = ["A common line of text", " a COMMON line of text\t", "short", "", "ünïcödé lîne", "ÜNÏCÖDÉ LÎNE", "x" * 9, "x" * 10,
            "\x0b padded line here \r", "padded line here", "\x85padded line here"] + [f"line number {k}" for k in range(60)]
    rows = [(k, "\n".join(random.choice(pool) for _ in range(random.randint(1, 12)))) for k in range(150)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (None, "A common line of text"), (903, "A common line of text\n" * 3000)]
    random.shuffle(rows)
    df = spark.createDataFrame([(*r, "key", 1) for r in rows], "doc_id long, text string, key string, lines int").repartition(5)
    assert result(df) == brute(rows)
    assert result(df, segments=1) == brute(rows)
    assert result(df.limit(0)) == []


def test_full_filters_change_nothing(spark, monkeypatch):
    import brightwell.llm.line_dedup as own

    monkeypatch.setattr(own, "MOST_BITS", 1 << 6)
    rows = [(k, f"only here {k}\nshared by all of them\npair {k // 2} of lines") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, segments=2) == brute(rows)


def test_rows_that_share_an_id_are_one_document(spark):
    rows = [(1, "twice in one document"), (1, "twice in one document"), (2, "twice in one document")]
    assert [r[3] for r in result(spark.createDataFrame(rows, "doc_id long, text string"))] == [0, 0, 1]


def test_rows_that_share_an_id_lose_their_own_lines(spark):
    rows = [(1, "shared line aa"), (2, "shared line aa"), (2, "shared line aa"), (2, "a unique line bb"),
            (2, "a unique line cc\nshared line aa"), (3, "a unique line bb\nkept by the third")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_filters_forget_nothing():
    hashes = np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64)
    bloom = Bloom(1 << 16)
    bloom.add(hashes)
    assert bloom.has(hashes).all()
    assert bloom.has(np.random.default_rng(2).integers(0, 1 << 62, 5000).astype(np.uint64)).mean() < 0.2


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in op4_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (n, k) for d, _, n, k in brute(rows)}


def test_segments_grow_with_the_lines(spark, monkeypatch):
    import brightwell.llm.line_dedup as own

    monkeypatch.setattr(own, "SEGMENT_HASHES", 128)
    rows = [(k, "\n".join([f"only in document {k} line {n}" for n in range(20)] + [f"shared by some of them {k % 5}"])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    segments = own.segments_for(df, "text")
    assert segments == -(-300 * 21 // 128)
    found = own.suspects(df, "text", segments)
    alone = own.hashes_of([f"only in document {k} line {n}".encode() for k in range(300) for n in range(20)])
    assert found.has(alone).mean() < 0.1 and found.has(own.hashes_of([f"shared by some of them {k}".encode() for k in range(5)])).all()
    assert result(df) == brute(rows)
    assert own.segments_for(df.limit(0), "text") == int(spark.conf.get("spark.sql.shuffle.partitions"))
