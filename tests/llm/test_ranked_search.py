import math
import random
import re
from collections import Counter

import numpy as np

import brightwell.llm.ranked_search as own
from brightwell.llm.queries import op13_ranked_search
from brightwell.llm.ranked_search import build_index, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own_terms in asked.items():
        scored = []
        for doc_id, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own_terms if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, doc_id, -score))
    return sorted(out, key=repr)


def result(docs, items, k):
    return sorted(map(tuple, search(build_index(docs), items, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(80)] + ["Ünï", "ünï", "É", "the", "The", "x1y"]
    text = lambda n: rng.choice([" ", ", ", "--\n"]).join(rng.choices(pool, k=n))
    docs = [(k, text(rng.randint(1, 60))) for k in range(400)]
    docs += [(1000 + k, docs[3][1]) for k in range(90)] + [(2000, None), (2001, ""), (2002, "?!"), (None, docs[3][1]), (None, "w1 w2"),
                                                           (7, docs[9][1]), (7, docs[9][1]), (2003, "w5 " * 5000 + "rare")]
    items = [(k, text(rng.randint(1, 12))) for k in range(25)] + [(100, docs[3][1]), (101, None), (102, ""), (103, "nowhere at-all"),
                                                                  (None, "w1 w7"), (104, "w1"), (104, "w2 rare"), (105, "RARE")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, size int, terms string").repartition(5),
            spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, query int"))


def test_against_brute_force(spark, monkeypatch):
    docs, items = rows_of(1)
    for k in (1, 7, 50):
        assert result(*frames(spark, docs, items), k) == brute(docs, items, k)
    monkeypatch.setattr(own, "BLOCK_TERMS", 9)
    monkeypatch.setattr(own, "DOCUMENTS_AT_ONCE", 16)
    assert result(*frames(spark, docs, items), 20) == brute(docs, items, 20)


def test_few_coordinates_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(own, "COORDINATES", 8)
    docs, items = rows_of(2)
    assert result(*frames(spark, docs, items), 10) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = frames(spark, *rows_of(3))
    assert result(docs.limit(0), items, 5) == [] and result(docs, items.limit(0), 5) == []


def test_terms_follow_the_pattern():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("aZ09 ,\x00\x7f_@[`{éİ中\U0001f600 ") for _ in range(30))
        assert [t.decode() for t in terms_of(text.encode()) if t] == terms(text)


def test_bounds_hold_and_prune(spark, monkeypatch):
    docs, items = rows_of(5)
    index = build_index(*frames(spark, docs, items)[:1]).toArrow()
    bases = np.array([50 + 50 * n * len(docs) // 9000 for n in index.column("size").to_pylist()])
    starts = np.concatenate([[0], np.cumsum([len(p) for p in index.column("places").to_pylist()])])
    asked, weights = [t.encode() for t in ("w1", "w2", "nowhere")], np.array([5, 7, 9])
    flat = lambda c: np.concatenate([np.array(x) for x in index.column(c).to_pylist()])
    bounds = own.bounds_of(flat("places"), flat("maxima"), starts, bases, own.coordinates(asked), weights, np.array([0]))
    close = 0
    for k, (words, counts) in enumerate(zip(index.column("terms").to_pylist(), index.column("counts").to_pylist())):
        tf = dict(zip(words, counts))
        exact = sum(int(w) * (1000000000 * tf[t.decode()] // (1000 * tf[t.decode()] + 20 * int(bases[k])))
                    for t, w in zip(asked, weights) if t.decode() in tf)
        assert bounds[k, 0] >= exact
        close += bounds[k, 0] == exact
    assert close > 0.95 * len(bases)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in op13_ranked_search(spark, folder).collect())
    assert got == sorted(brute(docs, items, 50))
