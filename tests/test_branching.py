import itertools
import random

import pytest

from traceloom.operators.branching import covered, merge_or, merge_sets
from traceloom.operators.facts import build_facts
from traceloom.plans.mine import Branching, mine, rule_rows

#: side bound -> {fixed: (merged, traces)}
TINY = {
    ("OR", "TARGET", 0): {"a": ("b,d", 4), "b": ("b,c", 3), "c": ("b,d", 2)},
    ("OR", "TARGET", 3): {"a": ("b,c,d", 4), "b": ("b,c,d", 3), "c": ("b,d", 2)},
    ("OR", "SOURCE", 2): {"a": ("a,b", 2), "b": ("a,c", 4), "c": ("a,b", 3), "d": ("b,c", 1)},
    ("AND", "TARGET", 0): {"a": ("b,c", 3), "b": ("a,b", 1), "c": ("b", 1)},
    ("AND", "SOURCE", 2): {"a": ("a,b", 1), "b": ("a,b", 1), "c": ("a,b", 2), "d": ("a,b", 1)},
    ("XOR", "TARGET", 3): {"a": ("a,c,d", 2), "b": ("a,b,c", 2), "c": ("b,d", 2)},
    ("XOR", "SOURCE", 2): {"a": ("a,b", 1), "b": ("a,b", 3), "c": ("a,b", 1)},
}


@pytest.mark.parametrize("case", list(TINY))
def test_tiny(tiny, case):
    policy, side, bound = case
    got = mine(tiny, ["response"], branching=Branching(policy, side, bound)).collect()
    assert {r.fixed: (r.merged, r.n_traces) for r in got} == TINY[case]


def _union(policy, sets):
    out = set()
    for i, s in enumerate(sets):
        out = s if i == 0 else out | s if policy == "OR" else out & s if policy == "AND" else out ^ s
    return out


@pytest.mark.parametrize("policy", ["OR", "AND", "XOR"])
def test_histogram_is_the_trace_sets(policy):
    rnd = random.Random(3)
    for _ in range(100):
        ops = {x: {t for t in range(12) if rnd.random() < 0.4} for x in "abcde"}
        hist = [(frozenset(x for x in ops if t in ops[x]), 1) for t in range(12) if any(t in s for s in ops.values())]
        have = sorted(set().union(*(s for s, _ in hist))) if hist else []
        for n in range(1, 4):
            for c in itertools.combinations(have, n):
                assert covered(policy, set(c), hist) == len(_union(policy, [ops[x] for x in c]))
        if policy != "OR" and len(have) > 1:
            got, n = merge_sets(policy, hist, 2, 0, False)
            assert n == max(len(_union(policy, [ops[x] for x in c])) for c in itertools.combinations(have, 2))
            assert n == covered(policy, set(got), hist)
        if policy == "OR" and have:
            got, n = merge_or(hist, 2, 0, 1.5)
            assert len(got) == min(2, len(have)) and n == covered("OR", set(got), hist)


def test_chain_rules_follow_their_base_rule(tiny):
    got = {r.fixed: (r.merged, r.n_traces) for r in mine(tiny, ["chain-response"], branching=Branching("AND", bound=2)).collect()}
    # a: only b has base rows of chain traces t1, t2; b -> c, d hold with a -> b in t1
    assert got["a"][1] == 1
    assert set(got) <= {"a", "b", "c"}


def test_rare_filter_bound_filter_and_errors(tiny):
    rare = mine(tiny, ["response"], branching=Branching("AND", bound=2, drop_rare=True)).collect()
    assert {r.fixed: r.merged for r in rare}["a"] == "b,c"
    exact = mine(tiny, ["response"], branching=Branching("OR", bound=3, exact_bound=True)).collect()
    assert {r.fixed for r in exact} == {"a", "b"}
    assert [r.side for r in mine(tiny, ["exactly"], branching=Branching("OR", "TARGET", 2)).limit(1).collect()] == ["SOURCE"]
    assert mine(tiny, ["first"], branching=Branching("OR", bound=2)).first().merged == "a,b"
    with pytest.raises(ValueError):
        mine(tiny, ["response"], branching=Branching("NAND"))


def _explicit(rows, policy, bound):
    """The greedy merge of one group by its trace sets, operand after operand."""
    left = sorted(rows)
    size = lambda c: len(_union(policy, [rows[x] for x in c]))
    if policy == "OR":
        while len(left) > bound:
            own = {x: len(rows[x] - set().union(*(rows[y] for y in left if y != x))) for x in left}
            left.remove(min(left, key=lambda x: (own[x], x)))
        return left, size(left)
    if len(left) == 1:
        return left, size(left)
    best = max(itertools.combinations(left, 2), key=lambda c: (size(c), [-ord(y) for x in c for y in x]))
    return sorted(best), size(best)


@pytest.mark.parametrize("policy", ["OR", "AND", "XOR"])
@pytest.mark.parametrize("side", ["TARGET", "SOURCE"])
def test_complements_are_branched_as_by_their_rows(spark, policy, side):
    rnd = random.Random(7)
    log = [(f"t{i}", rnd.choice("abcde"), p) for i in range(25) for p in range(rnd.randint(1, 4))]
    df = spark.createDataFrame(log, "trace string, event_type string, pos int").cache()
    f = build_facts(df, keep=True)
    for rule in ("co-existence", "not co-existence", "choice", "exclusive choice", "not-succession"):
        groups: dict = {}
        for r in rule_rows(f, rule).collect():
            fixed, operand = (r.event_a, r.event_b) if side == "TARGET" else (r.event_b, r.event_a)
            groups.setdefault(fixed, {}).setdefault(operand, set()).add(r.trace)
        want = {k: (",".join(m), n) for k, v in groups.items() for m, n in [_explicit(v, policy, 2)] if n}
        got = {r.fixed: (r.merged, r.n_traces) for r in mine(df, [rule], branching=Branching(policy, side, 2), facts=f).collect()}
        assert got == want, rule


def test_many_operands_and_the_bound(spark, monkeypatch):
    import traceloom.operators.branching as m

    rnd = random.Random(2)
    hist = [(frozenset(rnd.sample(range(400), rnd.randint(1, 60))), rnd.randint(1, 5)) for _ in range(3000)]
    hist = [(frozenset(f"a{x:03d}" for x in s), n) for s, n in hist]
    for policy in ("AND", "XOR"):
        got, n = merge_sets(policy, hist, 3, 0, False)
        assert len(got) == 3 and n == covered(policy, set(got), hist)
    got, n = merge_or(hist, 5, 0, 1.5)
    assert len(got) == 5 and n == covered("OR", set(got), hist)
    monkeypatch.setattr(m, "MEMBERS", 3)
    df = spark.createDataFrame([("t", x, i) for i, x in enumerate("abcde")], "trace string, event_type string, pos int")
    with pytest.raises(ValueError, match="more than 3 members"):
        mine(df, ["response"], branching=Branching("OR", bound=2))
