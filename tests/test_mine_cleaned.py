"""The rules of the raw log that say which activities do not meet, by their definitions."""

import os
from collections import defaultdict

import pytest

from traceloom.plans.mine import ALL_RULES
from traceloom.queries import queries
from traceloom.sources.cleaned import cleaned_log

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_all_rules_of_the_raw_log(spark):
    log = cleaned_log(spark.read.parquet(f"{DATA}/event_seq.parquet"), spark.read.parquet(f"{DATA}/activity.parquet"))
    at = defaultdict(lambda: defaultdict(list))
    traces = set()
    for r in log.select("trace", "event_type", "pos").collect():
        at[r.event_type][r.trace].append(r.pos)
        traces.add(r.trace)
    n, have = len(traces), {a: set(t) for a, t in at.items()}
    want = {}
    for a in at:
        counts = {len(p) for p in at[a].values()}
        for k in (*counts, max(counts) + 1):
            want["absence", a, str(k)] = n - sum(len(p) >= k for p in at[a].values())
        for b in at:
            x, y = have[a], have[b]
            want["co-existence", a, b] = n - len(x ^ y)
            want["not co-existence", a, b] = n - len(x & y) if a < b else n - len(x | y)
            if a < b:
                want["choice", a, b] = len(x | y)
                want["exclusive choice", a, b] = len(x ^ y)
            before = sum(min(at[a][t]) < max(at[b][t]) for t in x & y)
            if before:
                want["not-succession", a, b] = n - before
    got = {(r.rule, r.event_a, r.event_b): r.n_traces for r in queries()["mine_cleaned_log"](spark, DATA).collect()}
    assert {r for r, _, _ in got} <= set(ALL_RULES)
    rules = {r for r, _, _ in want}
    assert {x: k for x, k in got.items() if x[0] in rules} == {x: k for x, k in want.items() if k / n > 0.02}
