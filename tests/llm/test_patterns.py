import math
import random
from itertools import product

import pytest

from traceloom.llm.patterns import Miner, closed_patterns, frequent_counts, frequent_patterns, recover


def _in(p, s):
    it = iter(s)
    return all(x in it for x in p)


def _all(seqs, least, items, longest=8):
    out = {}
    for n in range(1, longest + 1):
        for p in product(items, repeat=n):
            k = sum(_in(p, s) for s in seqs)
            if k >= least:
                out[p] = k
    return out


def test_miner_against_definitions():
    rnd = random.Random(1)
    for _ in range(60):
        seqs = [[rnd.randrange(4) for _ in range(rnd.randint(0, 7))] for _ in range(rnd.randint(1, 10))]
        least = rnd.randint(2, 4)
        want = _all(seqs, least, range(4), 7)
        closed = Miner(seqs, least).run()
        assert recover(closed) == want
        assert closed == {p: k for p, k in want.items() if not any(len(q) == len(p) + 1 and want[q] == k and _in(p, q) for q in want)}
        names = sorted(want)
        assert Miner(seqs, 1).counts(names) == [want[p] for p in names]


def test_many_items_need_no_pair_table(monkeypatch):
    import traceloom.llm.patterns as m

    rnd = random.Random(6)
    seqs = [[rnd.randrange(5) for _ in range(8)] for _ in range(20)]
    plain = Miner(seqs, 5).run()
    monkeypatch.setattr(m, "PAIRED", 2)
    assert Miner(seqs, 5).run() == plain


def _frame(spark, seqs):
    rows = [(f"t{i}", "abcd"[x], p * 2, "extra") for i, s in enumerate(seqs) for p, x in enumerate(s)]
    return spark.createDataFrame([*rows, (None, "a", 0, ""), ("t0", None, 99, ""), ("t0", "a", None, "")], "trace string, event_type string, pos int, id string")


def test_shards_and_long_traces(spark):
    rnd = random.Random(4)
    seqs = [[rnd.randrange(4) for _ in range(rnd.randint(1, 6))] for _ in range(60)] + [[rnd.randrange(4) for _ in range(200)]]
    least = 0.33 * len(seqs)
    want = {tuple("abcd"[x] for x in p): k for p, k in _all(seqs, least, range(4), 6).items()}
    for shard, long in ((1000, 10_000), (17, 50)):
        closed, n = closed_patterns(_frame(spark, seqs), 0.33, shard=shard, long=long)
        assert n == len(seqs) and recover(closed) == want
    got = frequent_patterns(_frame(spark, seqs), 0.33, 2, 3, distinct=True).collect()
    assert {tuple(r.steps): r.n_traces for r in got} == {p: k for p, k in want.items() if len(p) in (2, 3) and len(set(p)) == len(p)}


def test_empty_and_rare(spark):
    df = _frame(spark, [[0], [1], [2]])
    assert closed_patterns(df.limit(0), 0.5) == ({}, 0)
    assert closed_patterns(df, 0.9) == ({}, 3)
    assert frequent_patterns(df, 0.9).count() == 0


def test_a_long_shared_process(spark):
    steps = [f"s{k:02d}" for k in range(24)]
    df = spark.createDataFrame([(f"t{i}", x, p) for i in range(20) for p, x in enumerate(steps)], "trace string, event_type string, pos int")
    got = frequent_patterns(df, 0.5, 3, 5, distinct=True, closed=False)
    assert got.count() == sum(math.comb(24, k) for k in (3, 4, 5)) and {r.n_traces for r in got.select("n_traces").distinct().collect()} == {20}
    with pytest.raises(Exception, match="more than 1000000 frequent patterns"):
        closed_patterns(df, 0.5)  # all of its 16 million subsequences


def test_mostly_long_traces_are_mined_by_levels(spark, monkeypatch):
    import traceloom.llm.patterns as m

    monkeypatch.setattr(m, "CHUNK", 7)
    rnd = random.Random(11)
    seqs = [[rnd.randrange(4) for _ in range(rnd.randint(3, 20))] for _ in range(30)]
    want = {tuple("abcd"[x] for x in p): k for p, k in _all(seqs, 0.4 * len(seqs), range(4), 4).items()}
    for long in (2, 8, 1000):
        got, n = frequent_counts(_frame(spark, seqs), 0.4, 1, 4, long=long)
        assert n == len(seqs) and got == want
        short, _ = frequent_counts(_frame(spark, seqs), 0.4, 2, 3, True, long=long, shard=60)
        assert short == {p: k for p, k in want.items() if len(p) in (2, 3) and len(set(p)) == len(p)}
    marked = {tuple(r.steps): r.closed for r in frequent_patterns(_frame(spark, seqs), 0.4, 1, 3).collect()}
    assert marked == {p: not any(len(q) == len(p) + 1 and c == want[p] and _in(p, q) for q, c in want.items()) for p in want if len(p) <= 3}
