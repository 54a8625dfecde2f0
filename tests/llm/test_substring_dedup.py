import random

import numpy as np

import brightwell.llm.substring_dedup as own
from brightwell.llm.queries import op11_substring_dedup
from brightwell.llm.substring_dedup import Sketch, estimated_repeated, run_hashes, window_keys, without_repeated_windows

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in BLANKS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, window):
    first = {}
    for doc_id, text in rows:
        words = words_of(text or "")
        for k in range(len(words) - window + 1 if doc_id is not None else 0):
            run = tuple(words[k:k + window])
            first[run] = min(first.get(run, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = words_of(text or "")
        gone = {p for k in range(len(words) - window + 1) if doc_id is not None and first[tuple(words[k:k + window])] < doc_id
                for p in range(k, k + window)}
        out.append((doc_id, " ".join(w for k, w in enumerate(words) if k not in gone), len(words), len(gone)))
    return sorted(out, key=repr)


def result(df, **options):
    found = without_repeated_windows(df, **options).select("doc_id", "text", "n_words", "n_removed")
    return sorted(map(tuple, found.collect()), key=repr)


def sample_rows(seed, window):
    rng = random.Random(seed)
    passages = [[f"p{n}w{k}" for k in range(rng.randint(window - 1, 3 * window))] for n in range(6)]
    loop = ["again"] * (2 * window)
    rows = []
    for doc_id in range(150):
        parts = [[f"d{doc_id}x{k}" if rng.random() < 0.5 else rng.choice("abc") for k in range(rng.randint(0, window))]
                 for _ in range(4)]
        words = [w for p in parts for w in (p + (rng.choice([*passages, loop, []])))]
        rows.append((doc_id, rng.choice([" ", "\n", "\t \r"]).join(words)))
    copies = [(500 + k, rows[k % 3][1]) for k in range(60)]
    near = [(700 + k, rows[5][1] + f" tail{k}") for k in range(40)]
    odd = [(900, None), (901, ""), (902, " \t\n"), (None, rows[0][1]), (None, None), (0, rows[0][1]), (3, rows[4][1]),
           (903, " " .join(f"one{k}" for k in range(2 * window))), (904, " ".join(f"Ünï{k % 7}" for k in range(4000))),
           (905, " ".join(f"Ünï{k % 7}" for k in range(4000)))]
    rows = rows + copies + near + odd
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, mark string, starts int, key int")


def test_against_brute_force(spark):
    for window in (5, 50):
        rows = sample_rows(window, window)
        df = frame(spark, rows).repartition(6)
        assert result(df, window=window) == brute(rows, window)
        assert result(df, window=window, segments=3) == brute(rows, window)


def test_many_small_parts_and_steps(spark, monkeypatch):
    monkeypatch.setattr(own, "PART_KEYS", 20)
    monkeypatch.setattr(own, "STEP", 64)
    monkeypatch.setattr(own, "BROADCAST_ROWS", 0)  # the joins that shuffle the texts
    rows = sample_rows(1, 8)
    assert result(frame(spark, rows).repartition(3), window=8, segments=2) == brute(rows, 8)


def test_full_sketches_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(Sketch, "width", 8)
    rows = sample_rows(2, 6)
    assert result(frame(spark, rows).repartition(4), window=6) == brute(rows, 6)


def test_empty_tables_and_short_texts(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    assert result(df) == [(1, "a b c", 3, 0), (2, "a b c", 3, 0), (3, "", 0, 0)]
    assert result(df.limit(0)) == []


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([rng.integers(0, 1 << 62, 37).astype(np.uint64), a[100:220], a[:9]])
    keys = window_keys(b, 50)
    assert (keys[37:37 + 71] == window_keys(a, 50)[100:171]).all()
    assert len(set(keys.tolist())) < len(keys) / 5
    assert (run_hashes(b, 7)[37:150] == run_hashes(a, 7)[100:213]).all()


def test_merged_sketches_never_underestimate(monkeypatch):
    monkeypatch.setattr(Sketch, "width", 4096)
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    parts = [keys[:400], keys[300:700], keys[650:]]
    merged = Sketch()
    for part in parts:
        merged.merge(*Sketch.folded(part))
    twice = np.concatenate([keys[300:400], keys[650:700]])
    assert estimated_repeated(merged.repeated(), twice).all()
    assert estimated_repeated(merged.repeated(), keys).mean() < 0.5


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in op11_substring_dedup(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((d, n, k) for d, _, n, k in brute(rows, 50))
