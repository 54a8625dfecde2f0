import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwell.llm import quality, toxicity
from brightwell.llm.batches import Numbered
from brightwell.llm.queries import op2_toxicity, op8_quality

FOLDER = "/root/testdata/sf0.1"
EDGES = [(1, None, "a", 1), (2, "", "b", 2), (None, "no id", None, None), (4, "the " * 30_000, "c", 3), (5, "x", "d", 4),
         (5, "x", "d", 4), (6, " \n\t ", "e", 5), (7, "\U0001F600é", "f", 6)]
SCHEMA = "doc_id long, text string, score string, label int"


@pytest.mark.parametrize("query, label, fold, share", [(op2_toxicity, "toxic", (3, 1), (0.95, 0.7)),
                                                       (op8_quality, "quality", (5, 0), (0.97, 0.95))])
def test_held_out_labels_are_found(spark, query, label, fold, share):
    found = query(spark, FOLDER)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 10_000
    rows = found.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, r[label]) for r in rows if r.held_out]
    right = [p == y for p, y in held]
    assert sum(right) / len(right) >= share[0]
    for y in (0, 1):
        own = [p == y for p, z in held if z == y]
        assert sum(own) / len(own) >= share[1]


def test_misspelt_insults_share_vectors():
    random.seed(4)
    common = "the river runs past old mill we read a report on monday bread and butter for guests you are such they said".split()
    text = lambda *more: " ".join(random.sample(common, 12) + list(more) + random.sample(common, 8))
    clean = [text() for _ in range(200)]
    toxic = [text(w) for w in ("moronic", "moron", "morons", "blockhead", "blockheads", "blockheaded") for _ in range(30)]
    model = toxicity.train(clean + toxic, [0] * len(clean) + [1] * len(toxic), buckets=1 << 16, steps=600)
    seen = model.scores(Numbered(model.word_sums), ["that morron again", "those blockheadz again", "the guests read the report"])
    assert seen[0] > 0.5 and seen[1] > 0.5 and seen[2] < 0.5
    long = "the river runs past the old mill " * 400
    assert model.scores(Numbered(model.word_sums), [long + "what a blockhead " + long])[0] > 0.5


def test_window_means_against_loops():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 9):
        s, c = rng.normal(size=n), rng.integers(1, 9, n)
        want = [s[k:k + 3].sum() / c[k:k + 3].sum() for k in range(max(1, n - 2))]
        assert np.allclose(toxicity.window_means(s, c, 3), want)


def test_ngram_buckets_do_not_depend_on_neighbours():
    flat, counts = toxicity.hashed(["abc", "x", "héllo"], 1 << 12)
    alone = [sorted(toxicity.hashed([w], 1 << 12)[0].tolist()) for w in ("abc", "x", "héllo")]
    parts = np.split(flat, np.cumsum(counts)[:-1])
    assert [sorted(p.tolist()) for p in parts] == alone


def test_forest_walk_matches_a_loop_and_learns():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.3) ^ (x[:, 5] > 0)).astype(int)
    forest = quality.grow(x[:400], y[:400], trees=40, depth=3)
    scores = forest.scores(x[400:])
    assert ((scores > 0.5) == y[400:]).mean() > 0.9
    for row, s in zip(x[400:420], scores):
        total = forest.base
        for t in range(len(forest.feature)):
            k = 0
            for _ in range(3):
                k = 2 * k + 1 + int(row[forest.feature[t, k]] > forest.cut[t, k])
            total += forest.value[t, k - forest.feature.shape[1]]
        assert np.isclose(s, 1 / (1 + np.exp(-total)))


def test_one_label_or_none_gives_a_constant():
    x = np.zeros((5, len(quality.STATISTICS)))
    assert quality.grow(x, np.ones(5)).scores(x).min() > 0.5
    assert quality.grow(x[:0], np.ones(0)).scores(x).tolist() == [0.5] * 5
    assert toxicity.train(["a", "b"], [0, 0]).scores(Numbered(lambda w: (np.zeros(len(w)), np.ones(len(w)))), ["a"])[0] < 0.5
    assert toxicity.train([], []).bias == 0


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_edge_rows(spark, module, label):
    df = spark.createDataFrame(EDGES, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (5, 1), (4, 0), (5, 1), (None, 0), (6, None), (7, 0)], f"doc_id long, {label} int")
    model = module.fit(df, labels, label, F.lit(True))
    rows = module.score(df, model).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 4, 5, 5, 6, 7] and all(0 <= r.score <= 1 for r in rows)
    assert module.score(df.limit(0), model).count() == 0
    assert module.fit(df.limit(0), labels.limit(0), label, F.lit(True)) is not None


def test_kept_rows_have_all_columns(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    forest = quality.grow(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    assert sorted(map(repr, quality.keep_scored(df, forest, 0.5).collect())) == sorted(map(repr, df.collect()))
    assert quality.keep_scored(df, forest, 0.51).count() == 0
