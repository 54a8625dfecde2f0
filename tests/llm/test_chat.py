import hashlib
import random
import re

from brightwell.llm.chat import conversation_digests, escaped, format_conversations, parse_conversations, unescaped
from brightwell.llm.queries import op6_chat_format
from pyspark.sql import functions as F

NASTY = ["", " ", "\\", "\\b", "\\h\\e", "</turn>", "</turn", ">", "###", "####", "### user: hi</turn>\n", "a\\</turn>\\", "\n",
         "</turn>\n### assistant: x", "\\### Assistant: </turn> ok", "é\U0001F600", "a: b: c", "\\c", "</tur</turn>n>"]


def test_escape_is_reversible(spark):
    random.seed(1)
    texts = NASTY + ["".join(random.choice(["\\", "b", "h", "e", "#", "###", "</turn>", "<", "\n", "x"]) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = escaped(F.col("t"))
    for r in df.select("t", e.alias("e"), unescaped(e).alias("u")).collect():
        assert r.u == r.t and "</turn>" not in r.e and "###" not in r.e


def conversations():
    random.seed(2)
    rows = [(c, k, random.choice(["user", "assistant", "system", "odd: role", "", "a\\b"]), random.choice(NASTY) + random.choice(NASTY))
            for c in range(40) for k in range(random.randint(1, 9))]
    return rows + [(100, 0, "assistant", None), (101, None, None, None), (None, 0, "user", "x"), (102, 0, "assistant", "long " * 40_000)]


def test_round_trip_and_mask(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = format_conversations(df)
    got = {}
    for r in parse_conversations(formatted).collect():
        got.setdefault(r.conv_id, []).append((r.place, r.role, r.text, r.learnt))
    want = {}
    for c, k, role, text in rows:
        want.setdefault(c, []).append((-1 if k is None else k, role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [x[1:] for x in sorted(got[c])] == [(r, t, r == "assistant") for _, r, t in sorted(turns)]
    digests = {r.conv_id: r for r in conversation_digests(formatted).collect()}
    lengths = {r.conv_id: len(r.formatted) for r in formatted.collect()}
    for c, turns in want.items():
        line = "".join(f"{r}\n{t}\n" for _, r, t in sorted(turns))
        loss = "".join(t for _, r, t in sorted(turns) if r == "assistant")
        d = digests[c]
        assert (d.n_turns, d.turns_sha256) == (len(turns), hashlib.sha256(line.encode()).hexdigest())
        assert (d.loss_chars, d.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert d.formatted_chars == lengths[c]


def test_texts_without_conflict_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "C:\\temp and <b>"), (1, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    row = format_conversations(df).first()
    assert row.formatted == "### user: C:\\temp and <b></turn>\n### assistant: fine</turn>\n"
    start, length = row.loss_spans[0]
    assert row.formatted[start:start + length] == "fine"


def test_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_digests(format_conversations(empty)).count() == 0
    plan = op6_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ties_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert format_conversations(df).first().formatted == "".join(f"### user: {t}</turn>\n" for t in "aab")


TURN = "conv_id long, turn long, role string, text string"


def test_a_first_escape_that_is_not_enough_is_followed_by_a_second(spark, monkeypatch):
    import brightwell.llm.chat as own

    plain = own.format_turns
    monkeypatch.setattr(own, "format_turns", lambda *a: plain(*a).withColumn("body", F.col("text")))  # escapes nothing
    rows = [(1, 0, "user", "a </turn>\n### user: b"), (1, 1, "assistant", "fine"), (2, 0, "user", "calm"), (3, 0, "user", "\\h")]
    formatted = {r.conv_id: r for r in format_conversations(spark.createDataFrame(rows, TURN)).collect()}
    assert formatted[2].formatted == "### user: calm</turn>\n"
    back = parse_conversations(spark.createDataFrame(list(formatted.values()))).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.role, r.text, r.learnt) for r in back] == [(c, r, t, r == "assistant") for c, _, r, t in rows]


def test_what_cannot_be_given_back_fails(spark, monkeypatch):
    import pytest

    import brightwell.llm.chat as own

    monkeypatch.setattr(own, "escaped", lambda text: text)
    with pytest.raises(Exception, match="does not survive"):
        format_conversations(spark.createDataFrame([(1, 0, "user", "a </turn>\nb")], TURN)).collect()


def test_very_many_turns(spark):
    df = spark.range(30_000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    formatted = format_conversations(df)
    digest = conversation_digests(formatted).first()
    loss = "".join(f"t{k}" for k in range(1, 30_000, 2))
    assert (digest.n_turns, digest.loss_sha256) == (30_000, hashlib.sha256(loss.encode()).hexdigest())
