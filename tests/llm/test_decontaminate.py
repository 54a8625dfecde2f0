import random
import re

from brightwell.llm.decontaminate import (build_index, contamination, item_words, proximity_matches, vocabulary, windows)

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return PATTERN.findall((text or "").translate(LOW))


def brute(docs, items, length):
    runs = [(k, w[i:i + length]) for k, t in items for w in [words(t)] if w for i in range(max(1, len(w) - length + 1))]
    out = {}
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, run in runs:
            for i in range(len(w) - len(run) + 1):
                if w[i:i + len(run)] == run:
                    hit.update(range(i, i + len(run)))
                    found.add(str(item))
        out[doc_id] = (len(w), len(hit), len(found), sorted(found), bool(hit))
    return out


def result(spark, docs, items, length):
    df = spark.createDataFrame([(*d, "t", 1) for d in docs], "doc_id long, text string, term string, run int").repartition(3)
    own = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, words int")
    return {r.doc_id: tuple(r[1:]) for r in contamination(df, own, length).collect()}


def test_against_brute_force(spark):
    random.seed(9)
    pool = ["the", "The", "a", "of", "été", "ÉTÉ", "x1", "rare", "river", "stone"]
    text = lambda n: "".join(random.choice(pool) + random.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(k, text(random.randint(1, 9))) for k in range(12)] + [(50, None), (51, "..."), (52, "solo"), (10, "of the of the of the")]
    docs = [(k, text(random.randint(0, 120))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "Solo solo. " * 400), (103, items[0][1]), (104, "of the " * 300), (None, items[1][1])]
    for length in (3, 5):
        assert result(spark, docs, items, length) == brute(docs, items, length)


def test_nothing_to_find(spark):
    docs = [(1, "some words here"), (2, None)]
    assert result(spark, docs, [(1, None), (2, "!")], 10) == {1: (3, 0, 0, [], False), 2: (0, 0, 0, [], False)}
    assert result(spark, docs, [(1, "absent words here and there")], 2)[1] == (3, 2, 1, ["1"], True)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert contamination(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame([], "item_id long, text string")).count() == 2


def test_rows_that_share_an_id(spark):
    got = result(spark, [(1, "alpha beta gamma"), (1, "delta epsilon zeta eta")], [(7, "alpha beta"), (8, "zeta eta")], 2)
    assert got == {1: (4, 4, 2, ["7", "8"], True)}


def test_repeated_rows_stay_contaminated(spark):
    docs = [(1, "x alpha beta gamma"), (1, "x alpha beta gamma"), (1, "x alpha beta gamma"), (2, "clean words"),
            (None, "alpha beta one"), (None, "alpha beta two")]
    got = result(spark, docs, [(7, "alpha beta"), (8, "alpha beta gamma")], 3)
    assert got == {1: (4, 3, 2, ["7", "8"], True), 2: (2, 0, 0, [], False), None: (3, 2, 1, ["7"], True)}


def test_proximity(spark):
    docs = [(1, "red fox jumps over a blue fence"), (2, "blue fox and red"), (3, "red one two three four blue"), (4, "fox")]
    items = item_words(spark.createDataFrame([(1, "red blue fox")], "item_id long, text string"))
    terms = vocabulary(items)
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"), terms)
    found = {within: {r.doc_id for r in proximity_matches(index, terms, windows(items), within).collect()} for within in (1, 3, 6)}
    assert found == {1: set(), 3: {2}, 6: {1, 2}}


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"), 2)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_are_searched_one_by_one(spark):
    docs = spark.createDataFrame([(1, "alpha x"), (1, "y beta"), (None, "alpha p q"), (None, "r beta s"), (2, "alpha beta"),
                                  (3, "z"), (3, "so alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in contamination(docs, items).collect()}
    assert got == {1: (2, 0, False), None: (3, 0, False), 2: (2, 2, True), 3: (3, 2, True)}
