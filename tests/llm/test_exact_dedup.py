import hashlib
import random

import pytest

from brightwell.llm.exact_dedup import BASES, PRIME, combine, exact_duplicates, polynomial

SPACE = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(SPACE), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text in rows:
        own = (text or "").translate(SPACE)
        best = min(groups[own])
        out.append((doc_id, best[3], len(groups[own]), best[3] == doc_id and -best[0] == len(text or ""),
                    hashlib.sha256(own.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(n=120):
    random.seed(12)
    texts = ["", " ", None, "a b", "ab", "a\nb ", "\x85ab", "a" * 5000, "a " * 5000, "é é", "éé", "AB", "long " * 40_000]
    return [(k, random.choice(texts) if k % 3 else f"text {k % 20}") for k in range(n)] + [(None, "ab"), (None, "alone here")]


def result(df, **options):
    return sorted(map(tuple, exact_duplicates(df, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"prime": 3, "bases": (1, 2, 1, 2)}, {"prime": 2, "bases": (1, 1, 1, 1)}])
def test_against_brute_force(spark, options):
    """Small primes make different texts collide, so that the comparison has to part them."""
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_bytes int, exact string").repartition(4)
    assert result(df, **options) == brute(rows)


def test_large_sets_of_groups_take_the_shuffle(spark, monkeypatch):
    import brightwell.llm.exact_dedup as own

    monkeypatch.setattr(own, "BROADCAST_ROWS", 1)
    rows = rows_of(60)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert result(df) == brute([(1, "a"), (2, "b")])
    assert result(df.limit(0)) == []


def test_repeated_rows_are_kept_together(spark):
    got = result(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id long, text string"))
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 3, True), (1, 3, True), (2, 3, False)]


def test_hashes_compose():
    random.seed(2)
    for n in (0, 1, 7, 4095, 4096, 4097, 20_000):
        data = random.randbytes(n)
        for base in BASES:
            slow = 0
            for byte in data:
                slow = (slow * base + byte + 1) % PRIME
            assert polynomial(data, base) == slow
            for cut in {0, n // 3, n}:
                left, right = polynomial(data[:cut], base), polynomial(data[cut:], base)
                assert combine(left, right, n - cut, base) == slow


def test_zeros_count():
    assert len({polynomial(bytes(n), BASES[0]) for n in range(10)}) == 10
