"""Properties of the small pieces that run inside tasks."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from brightwell.operators.replay import admit_within, breaker_step, window_step
from brightwell.operators.statements import split_log
from brightwell.sources.streams import start_options


def plain(times, calls, limit, window):
    held, passed = [], []
    for t, n in zip(times, calls):
        ok = 0
        for _ in range(n):
            if limit <= 0 or sum(1 for h in held if h > t - window) < limit:
                held.append(t)
                ok += 1
        passed.append(ok)
    return passed


MOMENTS = st.lists(st.integers(0, 60), unique=True, max_size=40).map(sorted)


@settings(max_examples=200, deadline=None)
@given(MOMENTS, st.integers(-1, 4), st.integers(1, 20), st.randoms())
def test_window_equals_a_plain_loop(times, limit, window, rng):
    calls = [rng.randrange(1, 5) for _ in times]
    passed, _ = admit_within(np.array(times, dtype="int64"), np.array(calls, dtype="int64"), limit, window, [])
    assert passed.tolist() == plain(times, calls, limit, window)


@settings(max_examples=200, deadline=None)
@given(MOMENTS, st.integers(1, 3), st.integers(0, 40))
def test_window_may_be_cut_anywhere(times, limit, cut):
    at = np.array(times, dtype="int64") * 1_000_000
    step, settle = window_step(7_000_000, "passed", limit=limit)
    ones = np.ones(len(at), dtype="int64")
    column = lambda a, b: lambda name: at[a:b] if name == "at_us" else ones[a:b]
    if not len(at):
        return
    whole = step("", column(0, len(at)))[1]["passed"]
    cut = min(cut, len(at))
    state, parts = "", []
    for a, b in ((0, cut), (cut, len(at))):
        if a < b:
            state, out = step(settle(state, int(at[a])), column(a, b))
            parts += out["passed"].tolist()
    assert parts == whole.tolist()


@settings(max_examples=100, deadline=None)
@given(MOMENTS, st.randoms(), st.integers(0, 40))
def test_breaker_may_be_cut_anywhere(times, rng, cut):
    at = np.array(times, dtype="int64") * 1_000_000
    failed = np.array([rng.random() < 0.5 for _ in times])
    step, settle = breaker_step(5, 0.5, 9_000_000)
    column = lambda a, b: lambda name: at[a:b] if name == "at_us" else failed[a:b]
    if not len(at):
        return
    whole = step("", column(0, len(at)))[1]["breaker"].tolist()
    cut = min(cut, len(at))
    state, parts = "", []
    for a, b in ((0, cut), (cut, len(at))):
        if a < b:
            state, out = step(settle(state, int(at[a])), column(a, b))
            parts += out["breaker"].tolist()
    assert parts == whole


def test_split_keeps_every_statement(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab '\n", k=rng.randint(1, 8))) for _ in range(3000)]
    texts = [t for t in texts if t.count("'") % 2 == 0 and t.strip()]
    scripts = [texts[k:k + 4] for k in range(0, len(texts), 4)]
    log = spark.createDataFrame([(k, ";".join(parts)) for k, parts in enumerate(scripts)], "id int, sql_text string")
    found = {}
    for r in split_log(log).orderBy("id", "position").collect():
        found.setdefault(r.id, []).append(r.statement)
    assert [found[k] for k in range(len(scripts))] == [[p.strip() for p in parts] for parts in scripts]


def test_start_positions():
    assert start_options("EARLIEST", "mysql") == {"startingOffsets": "earliest"}
    assert start_options("INITIAL", "postgresql", 5)["startingTimestamp"] == "5"
    for bad in (("EARLIEST", "postgresql"), ("SOON", "mysql")):
        with pytest.raises(ValueError):
            start_options(*bad)
