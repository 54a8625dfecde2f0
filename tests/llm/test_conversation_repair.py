import hashlib
import itertools
import random
import zlib

from brightwell.llm import conversation_repair as own
from brightwell.llm.conversation_repair import (CLOSING, FAR, Lattice, damaged, of_every_conversation, repaired_blocks,
                                                repaired_turns, solved, summaries, transfer)
from brightwell.llm.queries import op12_conversation_repair

SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least (cost, audit, turns) by trying all edits, layer by layer; ``rows`` are (role, text, fault)."""
    ahead = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit, turns) in list(best.items()):
                role = ahead[state]
                offer = (cost + 3, audit + "I", turns + [(role, "")])
                if role[0] not in best or offer[:2] < best[role[0]][:2]:
                    best[role[0]] = offer
        return best

    best = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        new = {}

        def offer(state, cost, audit, turns):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, turns)

        for state, (cost, audit, turns) in best.items():
            offer(state, cost + 4, audit + "D", turns)
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    offer(role[0], cost + more, audit + "K", turns + [(role, text)])
                offer(ahead[state][0], cost + 3 + more, audit + "R", turns + [(ahead[state], text)])
        best = inserted(new)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def brute(rows):
    """Per conversation of (conv_id, turn, role, text) the summary row."""
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv_id, own_rows in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])),
                                               key=lambda r: r[0]):
        own_rows, seen, graded = list(own_rows), set(), []
        for _, _, role, text in own_rows:
            body = text.rstrip(SPACE)
            fault = ("blank" if not body else "duplicate" if (role, text) in seen else
                     "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            graded.append((role, text, fault))
        cost, audit, turns = cheapest(graded)
        numbers = {t for _, t, _, _ in own_rows if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        kinds = [r[2][:1] for r in own_rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        faults = [sum(f == name for _, _, f in graded) for name in ("blank", "duplicate", "truncated")]
        joined = "\n".join(f"{r}:{t}" for r, t in turns)
        out.append((conv_id, gaps, *faults, illegal, cost, audit, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=repr)


def summary(df):
    return sorted(map(tuple, summaries(repaired_blocks(df)).collect()), key=repr)


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "Assistant", "agent"]
    texts = ["Fine.", "Why?", "cut off", "Done! \n", "", " \t", None, "Ünï.", "other one.", " ", "x" * 500 + "."]
    rows = []
    for conv_id in range(conversations):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"turn {turn} of {conv_id}" + rng.choice([".", "!", ""])
            rows.append((conv_id, turn if rng.random() < 0.8 else rng.choice([None, 3, 9]), role, text))
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


def test_against_brute_force(spark):
    rows = random_rows(1, 120, 9) + [(None, 1, "user", "No id."), (None, 2, "assistant", "None."), (None, 2, "assistant", "None.")]
    rows += [(500, None, None, None), (501, 1, "assistant", "Alone."), (502, 5, "system", "Only this.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS + ", letter string, block int").repartition(5)
    assert summary(df) == brute(rows)
    assert summary(df.limit(0)) == []


def test_long_conversations_span_blocks(spark, monkeypatch):
    monkeypatch.setattr(own, "BLOCK", 5)
    rows = random_rows(2, 12, 60) + [(100, k, "system", f"System {k}.") for k in range(23)]
    rows += [(101, k, "user", "Same.") for k in range(30)] + [(102, 1, "user", "Equal.")] * 40
    rows += [(103, k, ("assistant", "user")[k % 2], f"Swapped {k}.") for k in range(41)]
    assert summary(spark.createDataFrame(rows, COLUMNS).repartition(7)) == brute(rows)


def test_one_conversation_with_many_rows(spark):
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"Text {k}" + rng.choice([".", ".", ""])) for k in range(4000)]
    got, = summary(spark.createDataFrame(rows, COLUMNS).repartition(8))
    assert got == brute(rows)[0]


def test_auction_finds_shortest_paths():
    rng = random.Random(3)
    for _ in range(300):
        symbols = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, 9)))
        matrix = [transfer(symbols)[4 * k:4 * k + 4] for k in range(4)]
        ends = tuple(rng.randint(0, 9) for _ in range(4))
        for entry in range(4):
            cost, audit, state = solved(symbols, ends, entry)
            assert cost == matrix[entry][state] and cost + ends[state] == min(m + e for m, e in zip(matrix[entry], ends))
            assert len(audit) - audit.count("I") == len(symbols)
        assert max(matrix[2][:2]) == FAR


def test_converged_prices_make_cheapest_paths_tight():
    lattice = Lattice("595b6d9", CLOSING)
    cost = lattice.auction(0)
    assert lattice.prices[0][0] == cost
    for layer, symbol in enumerate(lattice.rows):
        for state in range(4):
            for _, length, ahead, head in own.ARCS[symbol][state]:
                assert lattice.prices[layer][state] <= length + lattice.prices[layer + ahead][head]


def test_damage(spark):
    rows = [(k, t, "assistant", "One. Two! Three?") for k in range(40) for t in range(3)] + [(None, None, None, None), (7, None, "user", None)]
    expected = []
    for conv_id, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{name(conv_id)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        role, text = "user" if code == 4 else role, "" if code == 1 else text.translate({ord(c): None for c in ".!?"}) if code == 2 else text
        expected += [(conv_id, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    got = damaged(spark.createDataFrame(rows, COLUMNS))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_turns_and_conversations_without_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hello.")], COLUMNS)
    blocks = repaired_blocks(df)
    assert [(r.role, r.text) for r in repaired_turns(blocks).orderBy("block", "place").collect()] == [
        ("user", "Hi."), ("assistant", "Hello.")]
    ids = spark.createDataFrame([(1,), (2,), (None,), (2,)], "conv_id long")
    rows = {r.conv_id: r for r in of_every_conversation(summaries(blocks), ids).collect()}
    assert set(rows) == {1, 2, None} and (rows[1].cost, rows[1].audit) == (3, "KR")
    assert rows[2].audit == "" and rows[2].cost == 0 and rows[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    expected = {r[0]: r for r in brute([tuple(r) for r in damaged(table).collect()])}
    got = {r.conv_id: tuple(r) for r in op12_conversation_repair(spark, folder).collect()}
    assert set(got) == {r.conv_id for r in table.collect()}
    assert all(got[k] == expected[k] for k in expected)
