import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor

from brightwell.llm.piece_bpe import PieceEncoder, PieceTable, decode, encode, round_trip_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
ENCODER = PieceEncoder(PATH)
TEXTS = ["", " ", "  ", "a  b", " a", "a ", "▁", "▁▁x▁", "a\tb\n\n", "the then there", "aaaaaaaaaaaaaaaa", " " * 40, "ﬁ Å ½",
         "\x00", "한국어 अ \U0001F600\U0001F1E9", "<s> </s> <unk> <0x0A>", "é​￼", "x" * 3000, "Donau" * 500]


def ids(texts):
    return [np.frombuffer(x, "<i4").tolist() for x in ENCODER.encode(texts)]


def test_listed_texts():
    assert ids(TEXTS) == [LIBRARY.encode(t) for t in TEXTS]
    for own in ids(TEXTS):
        assert ENCODER.table.decode(own) == LIBRARY.decode(own)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab ▁tehrinds\n.éß\U0001F600한\x00अAT") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(text):
    own = ids([text])[0]
    assert own == LIBRARY.encode(text) and ENCODER.table.decode(own) == LIBRARY.decode(own)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 13, 259, 300, 29871, 1000, 229, 133, 158, 258, 3]) | st.integers(0, 31999), max_size=8))
def test_any_ids(own):
    assert ENCODER.table.decode(own) == LIBRARY.decode(own)


def test_many_words_at_once_equal_one_by_one():
    random.seed(6)
    words = ["▁" + "".join(random.choice("thenrasioé▁") for _ in range(random.randint(0, 15))) for _ in range(3000)]
    table = PieceTable(PATH)
    flat, sizes = table.encode_words(words)
    ends = np.cumsum(sizes)
    for w, a, b in zip(words[:400], ends - sizes, ends):
        assert flat[a:b].tolist() == table.encode_words([w])[0].tolist()


def test_rows(spark):
    rows = [(k, t, "i", 0) for k, t in enumerate(TEXTS)] + [(None, "x y", None, None), (0, "", "i", 0), (77, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = sorted(((r.doc_id, list(r.ids), r.text) for r in decode(encode(df, PATH), PATH).collect()), key=repr)
    assert got == sorted(((d, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for d, t, *_ in rows), key=repr)
    digest = {r.doc_id: r for r in round_trip_digests(df, PATH).collect()}
    own = LIBRARY.encode(TEXTS[9])
    assert digest[9].ids_sha256 == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
    assert digest[9].decoded_sha256 == hashlib.sha256(LIBRARY.decode(own).encode()).hexdigest()
    assert digest[77].n_tokens == 0 and digest[77].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert encode(df.limit(0), PATH).count() == 0


def test_vocabulary_with_inner_blanks_is_refused(monkeypatch):
    import brightwell.llm.piece_bpe as own

    class Other:
        def __init__(self, model_file):
            self.pieces = ["<unk>", "a▁b"]

        get_piece_size = lambda self: 2
        id_to_piece = lambda self, k: [self.pieces[x] for x in k]
        get_score = lambda self, k: [0.0 for _ in k]
        is_unknown = lambda self, k: k == 0
        is_control = is_byte = is_unused = lambda self, k: False
        unk_id = lambda self: 0

    monkeypatch.setattr(own, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError):
        PieceTable("x")


def test_long_texts_without_blanks():
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)), "the" * 9_000, "ab" * 9_000 + "a" * 9_001,
             "".join(rng.choices("ACGTacgt0123456789+/=", k=20_000)), "中文字符的测试" * 2_000, "then there the " * 5 + "thethen" * 4_000,
             "".join(rng.choice(["ing", "tion", "aa", "a", "\n", "é", "\U0001F600", "0", "00"]) for _ in range(15_000)), "\n" * 8_000]
    assert ids(texts) == [LIBRARY.encode(t) for t in texts]


def test_a_million_characters_without_a_blank():
    text = "".join(random.Random(12).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    assert ids([text])[0] == LIBRARY.encode(text)


def test_long_words_are_not_kept():
    encoder = PieceEncoder(PATH)
    encoder.encode(["x" * 500 + " short"])
    assert max(map(len, encoder.words.recent)) <= encoder.words.longest
