import random

import pytest
from pyspark.sql import functions as F

from tests.brute import rule_rows as brute
from traceloom.operators import blocks
from traceloom.operators.facts import build_facts
from traceloom.operators.neighbours import with_neighbours
from traceloom.operators.ordered import alternations
from traceloom.plans.mine import ALL_RULES, Branching, mine, rule_rows

TINY_RESPONSE = {("a", "a"): "t2 t5", ("a", "b"): "t1 t2 t3 t5", ("a", "c"): "t1 t3 t5", ("a", "d"): "t1", ("b", "a"): "t2", ("b", "b"): "t2", ("b", "c"): "t1 t5", ("b", "d"): "t1", ("c", "b"): "t3", ("c", "d"): "t1"}


def _frame(spark, traces):
    return spark.createDataFrame([(t, e, i) for t, s in traces.items() for i, e in enumerate(s)], "trace string, event_type string, pos int")


def test_tiny_response(tiny):
    got = {}
    for r in rule_rows(build_facts(tiny), "response").collect():
        got.setdefault((r.event_a, r.event_b), []).append(r.trace)
    assert {k: " ".join(sorted(v)) for k, v in got.items()} == TINY_RESPONSE


@pytest.mark.parametrize("seed", [1, 2])
def test_all_rules_against_definitions(spark, seed):
    rnd = random.Random(seed)
    traces = {f"t{i}": [rnd.choice("abcde") for _ in range(rnd.choice([1, 2, 3, 5, 9, 14]))] for i in range(40)}
    df = _frame(spark, traces).cache()
    f = build_facts(df, keep=True)
    want = brute(traces)
    got: dict = {}
    for rule in ALL_RULES:
        for r in rule_rows(f, rule).collect():
            got.setdefault((r.rule, r.event_a, r.event_b), set()).add(r.trace)
    assert got == want
    counts = {(r.rule, r.event_a, r.event_b): (r.n_traces, r.support) for r in mine(df, facts=f).collect()}
    assert counts == {k: (len(v), len(v) / len(traces)) for k, v in want.items()}


def test_long_traces_give_the_same_alternations(spark):
    rnd = random.Random(5)
    df = _frame(spark, {f"t{i}": [rnd.choice("abcd") for _ in range(30)] for i in range(6)}).cache()
    f = build_facts(df)
    rows = lambda n: sorted(map(tuple, alternations(f, n).collect()))
    assert rows(1) == rows(1000)


def test_neighbours_across_chunks(spark):
    rnd = random.Random(9)
    rows = [(k, p, rnd.randrange(5)) for k in "xyz" for p in sorted(rnd.sample(range(-20, 200), 60))]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    small = sorted(map(tuple, with_neighbours(df, ["k"], "p", ["v"], chunk=7).collect()))
    whole = sorted(map(tuple, with_neighbours(df, ["k"], "p", ["v"], chunk=10_000).collect()))
    assert small == whole


def test_nulls_ties_and_empty_logs(spark):
    df = spark.createDataFrame([("t", "a", 0), (None, "a", 1), ("t", None, 1), ("t", "b", None), ("t", "b", 2)], "trace string, event_type string, pos int")
    assert {(r.event_a, r.event_b): r.n_traces for r in mine(df, ["response"]).collect()} == {("a", "b"): 1}
    empty = df.limit(0)
    assert mine(empty).count() == 0
    assert mine(empty, ["response"], branching=Branching("OR", bound=2)).count() == 0


def test_threshold_is_strict(tiny):
    assert {(r.event_a, r.event_b) for r in mine(tiny, ["response"], support=0.6).collect()} == {("a", "b")}


@pytest.mark.parametrize("block,span", [(1, 1), (3, 2), (7, 100)])
def test_alternations_and_pairs_over_blocks(spark, block, span):
    rnd = random.Random(block)
    traces = {f"t{i}": [rnd.choice("abcdefg"[: rnd.randint(2, 7)]) for _ in range(rnd.choice([1, 5, 40]))] for i in range(12)}
    gaps = [(t, e, i * 3 + (5 if i > 3 else 0)) for t, s in traces.items() for i, e in enumerate(s)]
    df = spark.createDataFrame(gaps, "trace string, event_type string, pos int").cache()
    by: dict = {}
    for t, e, p in gaps:
        by.setdefault(t, []).append((p, e))
    g, near, every = {}, set(), set()
    for t, s in by.items():
        for k, (q, b) in enumerate(s):
            every |= {(a, b, t, p, q) for p, a in s[:k]}
            near |= {(a, b, t, max(p for p, x in s[:k] if x == a), q) for a in {x for _, x in s[:k]}}
        for a in {e for _, e in s}:
            for b in {e for _, e in s} - {a}:
                only = [e for _, e in s if e in (a, b)]
                if n := sum(x == a and y == b for x, y in zip(only, only[1:])):
                    g[a, b, t] = n
    assert {(r.event_a, r.event_b, r.trace): r.g for r in blocks.alternations(df, block, span).collect()} == g
    assert sorted(map(tuple, blocks.nearest_before(df, block, span).collect())) == sorted(near)
    assert sorted(map(tuple, blocks.every_pair(df, block).collect())) == sorted(every)


def test_no_task_holds_a_hot_trace(spark):
    """One trace of 300,000 events: the rows that alternate rules sort or join are spread over its blocks."""
    df = spark.range(300_000).selectExpr("'t' as trace", "concat('e', cast(pmod(xxhash64(id), 6) as string)) as event_type", "cast(id as int) as pos")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would merge what is small
    per = blocks.in_blocks(df).groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) == 4 and max(r["count"] for r in per) < 100_000
    assert blocks.in_blocks(df).groupBy("trace", "_block").count().agg(F.max("count")).first()[0] <= blocks.BLOCK
    before = blocks.carried(blocks.in_blocks(df), 256)
    assert before.groupBy("trace", "_block").count().agg(F.max("count")).first()[0] == 6
    f = build_facts(df, neighbours=False)
    rows = alternations(f).collect()
    assert len(rows) == 30 and not rule_rows(f, "alternate-response").count()
