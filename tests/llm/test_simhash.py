import random
import re

import numpy as np
import xxhash

from brightwell.llm.queries import op9_simhash
from brightwell.llm.simhash import components, fingerprint, linked_codes, near_duplicates, near_pairs, shard_tree
from pyspark.sql import functions as F

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, bits=2):
    codes = {d: slow_fingerprint(t) for d, t in rows}
    own = {d: d for d in codes}
    while True:
        new = {a: min(own[b] for b in codes if (codes[a] ^ codes[b]).bit_count() <= bits) for a in codes}
        if new == own:
            return {d: (f"{codes[d]:016x}", own[d]) for d in codes}
        own = new


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 62, n // 8 + 1).astype(np.uint64)
    noise = [np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64) for _ in range(3)]
    return np.unique(centre[rng.integers(0, len(centre), n)] ^ noise[0] ^ noise[1] ^ noise[2])


def slow_pairs(codes, bits):
    d = np.bitwise_count(codes[:, None] ^ codes[None, :])
    a, b = np.nonzero(d <= bits)
    return {(int(codes[x]), int(codes[y])) for x, y in zip(a, b) if codes[x] < codes[y]}


def test_fingerprint_by_hand():
    random.seed(3)
    texts = ["", " \n", "One", "one TWO", "a b c", "a  b\tc\x0bd\x0ce", "É é Ü", "x y " * 200,
             " ".join(random.choice("abcdefg") for _ in range(3000))]
    assert [fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_fingerprint_of_very_long_text(monkeypatch):
    import brightwell.llm.simhash as own

    text = " ".join(str(k % 977) for k in range(5000))
    whole = fingerprint(text)
    monkeypatch.setattr(own, "SHINGLES_AT_ONCE", 64)
    assert fingerprint(text) == whole == slow_fingerprint(text)


def test_tree_search_finds_every_pair():
    for n, seed in ((30, 1), (700, 2), (3000, 3)):
        codes = clustered(n, seed)
        for bits in (0, 2, 4):
            got = [(int(a), int(b)) for q, m in near_pairs(codes, codes, bits) for a, b in zip(q, m)]
            assert len(got) == len(set(got)) and set(got) == slow_pairs(codes, bits)


def test_balls_visit_every_shard_with_a_neighbour():
    codes = clustered(3000, 5)
    tree = shard_tree(codes, 30)
    order, home = tree.visit(codes, 0)
    home = home[np.argsort(order)]
    rows, shards = tree.visit(codes, 2)
    visited = set(zip(rows.tolist(), shards.tolist()))
    d = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert len(tree.point) > 10 and all((a, home[b]) in visited for a, b in zip(*np.nonzero(d <= 2)))


def test_links_over_shards(spark):
    codes = clustered(3000, 7)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long").repartition(4)
    for options in ({"shard": 100}, {"shard": 100, "sample": 300}, {}):
        got = linked_codes(df, 2, **options).collect()
        pairs = {tuple(int(x) for x in np.array(r, dtype=np.int64).view(np.uint64)) for r in got}
        assert len(got) == len(pairs) and pairs == slow_pairs(codes, 2)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(200, 260)] + [(300, 301), (301, 300), (302, 301), (5, 5)]
    random.seed(1)
    random.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, **{k: 100 for k in range(200, 260)}, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    random.seed(8)
    base = [" ".join(random.choice("abcdefghij") * 3 for _ in range(400)) for _ in range(6)]
    rows = [(k, base[k % 6] + (f" tail{k}" if k % 4 == 0 else "")) for k in range(60)]
    rows += [(200, ""), (201, None), (202, " \n"), (203, "word " * 60_000)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, code string, shard int").repartition(3)
    got = {r.doc_id: (f"{r.code & (2 ** 64 - 1):016x}", r.component_id) for r in near_duplicates(df).collect()}
    assert got == slow_components(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "z z z z")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=repr) == [
        (7, 7), (7, 7), (None, 7), (None, None)]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == slow_components(rows)


def test_native_hash_is_the_same(spark):
    row = spark.createDataFrame([("été one two",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h & (2 ** 64 - 1) == xxhash.xxh64_intdigest("été one two".encode(), 42)


def test_the_driver_sees_a_fraction_of_the_codes(spark, monkeypatch):
    import brightwell.llm.simhash as own

    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, 6000, dtype=np.int64)
    codes = np.unique(np.concatenate([base, base[:500] ^ 5]))
    seen, plain = [], own.shard_tree
    monkeypatch.setattr(own, "shard_tree", lambda sample, shards: seen.append(len(sample)) or plain(sample, shards))
    df = spark.createDataFrame([(int(c),) for c in codes], "code long")
    links = {(r.a, r.b) for r in own.linked_codes(df, 2, shard=512).collect()}
    found = {frozenset(x) for x in links}
    assert all(frozenset((int(c), int(c) ^ 5)) in found for c in base[:500])
    assert 0 < seen[0] < len(codes) / 5
    own.linked_codes(df.limit(100), 2)
    assert seen[1] == 0  # one shard needs no vantage point
