import math
import random

import pytest

from traceloom.llm.sets import constraint_sets, member_set
from traceloom.llm.similar import _copies, class_pairs, classes, similar_pairs, trees_for


def _brute(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-9}


def _data(seed=1, n=300):
    rnd = random.Random(seed)
    sets = {}
    for i in range(n):
        if sets and rnd.random() < 0.5:
            base = set(sets[rnd.choice(list(sets))])
            for _ in range(rnd.randint(0, max(1, len(base) // 4))):
                base.discard(rnd.choice(sorted(base) or ["x"]))
                base.add(f"t{rnd.randrange(400)}")
            sets[i] = frozenset(base)
        else:
            sets[i] = frozenset({"hot", *(f"t{rnd.randrange(400)}" for _ in range(rnd.randint(0, 25)))})
    return sets


@pytest.mark.parametrize("leaf", [64, 4])
def test_against_all_pairs(spark, leaf):
    sets = _data()
    df = spark.createDataFrame([(i, sorted(s), "x") for i, s in sets.items()], "id bigint, members array<string>, rep string")
    got = {(r.id_a, r.id_b): r.similarity for r in similar_pairs(df, 0.7, leaf=leaf).collect()}
    want = _brute(sets, 0.7)
    assert set(got) <= want and len(got) >= 0.99 * len(want)
    assert all(abs(s - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-9 for (a, b), s in got.items())


def test_blocks_at_the_last_level(spark):
    sets = _data(3, 120)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, members array<string>")
    reps, _ = classes(df)
    rep_sets = {r.rep: frozenset(r.members) for r in reps.collect()}
    got = {tuple(sorted((r.rep_a, r.rep_b))) for r in class_pairs(reps, 0.5, leaf=1, max_depth=1).collect()}
    want = _brute(rep_sets, 0.5)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_copies_nulls_and_empty(spark):
    rows = [(1, ["a", "b"]), (2, ["b", "a", "a"]), (3, None), (4, []), (5, [None]), (6, ["a", None]), (None, ["a"]), (1, ["a", "b"]), (7, ["a,b"]), (8, ["x" * 100_000])]
    df = spark.createDataFrame(rows, "id bigint, members array<string>")
    assert sorted((r.id_a, r.id_b) for r in similar_pairs(df, 0.7).collect()) == [(1, 2)]
    assert sorted((r.id_a, r.id_b) for r in similar_pairs(df, 0.5).collect()) == [(1, 2), (1, 6), (2, 6)]
    assert similar_pairs(df.limit(0), 0.7).count() == 0
    with pytest.raises(ValueError):
        class_pairs(df, 0)


def test_trees_grow_with_recall():
    assert trees_for(0.9) < trees_for(0.9999)
    # the chance that two records part company somewhere on the way, over many levels
    met = 1.0
    for _ in range(60):
        met = 1 - math.exp(-1.6 * met)
    assert (1 - met) ** trees_for(0.9999, 1.6) <= 1e-4 < (1 - met) ** (trees_for(0.9999, 1.6) - 1)


def test_many_copies_in_blocks(spark):
    rows = [(i, i // 40) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, rep bigint")
    got = [tuple(r) for r in _copies(df, 7).collect()]
    assert sorted(got) == sorted((a, b) for a, x in rows for b, y in rows if a < b and x == y)


def test_constraint_sets(spark):
    pair = spark.createDataFrame([(1, "r", None, None, [" A\t", "a", None, "", "B"], None), (1, "r", "x", None, [" A\t", "a", None, "", "B"], None), (2, None, None, None, None, None)], "constraint_id bigint, rule string, event_a string, event_b string, traces array<string>, mined_at timestamp_ntz")
    pos = spark.createDataFrame([(3, "first", "e", [" "], None), (4, "last", "e", [" z "], None), (None, "last", "e", ["q"], None)], "constraint_id bigint, rule string, event_type string, traces array<string>, mined_at timestamp_ntz")
    assert {r.id: r.members for r in constraint_sets(pair, pos).collect()} == {1: ["a", "b"], 4: ["z"]}
    assert pair.select(member_set(pair.traces).alias("m")).first().m == ["a", "b"]
