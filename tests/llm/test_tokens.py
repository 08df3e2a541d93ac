import random

import pytest
import tiktoken

from traceloom.llm.tokens import PIECES, VOCABULARY, Encoder, Transducer, Utf8Machine, decode, decoded, encode, encoder


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=encoder().transducer.ranks, special_tokens={})


def test_equal_to_a_reference_encoder(plain):
    rnd = random.Random(3)
    parts = ["a", "the", "ing", " ", "  ", "\n", "-", "=", "é", "ß", "日本", "😀", "0", "​", "ſ", "...", "__", "aaaa", "\t", "\x00", "'s", "<|endoftext|>", "é"]
    for _ in range(2000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        ids = encoder().encode(s)
        assert ids == plain.encode_ordinary(s)
        assert "".join(decode(ids, encoder().transducer.tokens)) == s


def test_very_long_pieces(plain):
    for s in ("a" * 50_000, " " * 20_000, "ab" * 30_000, "日" * 5000, "x \n" * 500_000):
        assert encoder().encode(s) == plain.encode_ordinary(s)


def test_forgetting_states_changes_nothing(plain, monkeypatch):
    import traceloom.llm.tokens as m

    monkeypatch.setattr(m, "STATES", 20)
    monkeypatch.setattr(m, "KEPT", 3)
    enc = Encoder(encoder().transducer.ranks)
    for s in ("some unusual words, joined" * 5, "q" * 300 + "zxzx" * 100, "Größenwahn überall " * 4):
        assert enc.encode(s) == plain.encode_ordinary(s)


def test_small_vocabulary_by_definition():
    rnd = random.Random(1)
    for _ in range(30):
        ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
        while len(ranks) < 20:
            made = rnd.choice(list(ranks)) + rnd.choice(list(ranks))
            t = Transducer(ranks)
            if made not in ranks and len(t.merged(made)) == 2:
                ranks[made] = len(ranks)
        t = Transducer(ranks)
        for _ in range(50):
            s = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 25)))
            assert list(t.piece(s)) == t.merged(s)


def test_utf8_machine():
    text = "aé日😀z"
    data = text.encode()
    m = Utf8Machine()
    assert "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.end() == text
    for bad in (b"\xff", b"\xc3(", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf0\x9f", b"a\x80b", b"\xe6\x97"):
        m = Utf8Machine()
        assert m.feed(bad) + m.end() == bad.decode("utf-8", "replace")


def test_frame(spark, plain):
    rows = [(1, "some text", 5), (2, "", 5), (3, None, 5), (None, "x", 5), (1, "some text", 5), (4, "word " * 300_000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = encode(df, path=VOCABULARY).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(((i, plain.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    back = {r.doc_id: r.text for r in decoded(encode(df)).collect()}
    assert back[1] == "some text" and back[2] == "" and back[3] == "" and back[4] == "word " * 300_000
    assert encode(df.limit(0)).count() == 0
