"""Totals worked out by hand-written per-trace code, and generated batches."""

import datetime as dt
import os

import pytest

from traceloom.plans.incremental import MiningState, affected_events, new_events, trace_bounds
from traceloom.plans.mine import mine
from traceloom.plans.report import differences, report_lines, trace_lines
from traceloom.sources import logs
from traceloom.sources.batches import make_batches

DATA = "/root/testdata/sf0.001"
#: rule: (rows, traces over rows) of the user-day log
TOTALS = {
    "absence": (21, 7337), "alternate-precedence": (25, 674), "alternate-response": (20, 469), "alternate-succession": (20, 355), "chain-precedence": (20, 343),
    "chain-response": (20, 323), "chain-succession": (20, 235), "choice": (10, 2611), "co-existence": (25, 5817), "exactly": (16, 792), "exclusive choice": (10, 2054),
    "existence": (16, 1000), "first": (5, 397), "last": (5, 298), "not co-existence": (25, 5965), "not-chain-succession": (20, 146), "not-succession": (25, 9101),
    "precedence": (25, 738), "responded existence": (25, 1906), "response": (25, 824), "succession": (25, 738),
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_totals(spark):
    log = logs.events_user_day(spark, DATA)
    got: dict = {}
    for r in mine(log).collect():
        n, t = got.get(r.rule, (0, 0))
        got[r.rule] = (n + 1, t + r.n_traces)
    assert got == TOTALS
    fresh = new_events(log, "2024-01-20 12:00:00")
    bounds = trace_bounds(fresh)
    assert (fresh.count(), bounds.count(), bounds.where("min_pos > 0").count(), affected_events(log, bounds).count()) == (317, 139, 6, 326)


def _log(spark):
    rows = [(f"t{i}", "abc"[(i * p + p) % 3], dt.datetime(2024, 1, 1) + dt.timedelta(hours=p), p) for i in range(40) for p in range(i % 6 + 1)]
    return spark.createDataFrame(rows, "trace string, event_type string, ts timestamp_ntz, pos int")


def test_generated_batches(spark, tmp_path):
    log = _log(spark)
    parts = [b.cache() for b in make_batches(log, 3, copied=0.3, continued=0.4)]
    assert [b.count() for b in parts] == [b.count() for b in make_batches(log, 3, copied=0.3, continued=0.4)]
    names = [{r.trace for r in b.select("trace").distinct().collect()} for b in parts]
    assert names[0] & names[1] and len(names[0]) > 40
    state = MiningState(spark, str(tmp_path / "s"))
    for b in parts:
        state.update(b)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert differences(report_lines(state.mine()), report_lines(mine(whole))).count() == 0


def test_text_log_and_reports(spark, tmp_path, tiny):
    log = _log(spark)
    logs.write_with_timestamp(log, str(tmp_path / "log"))
    assert sorted(map(tuple, logs.read_with_timestamp(spark, str(tmp_path / "log")).collect())) == sorted(map(tuple, log.collect()))
    from traceloom.operators.facts import build_facts
    from traceloom.plans.mine import rule_rows

    lines = {r.line for r in trace_lines(rule_rows(build_facts(tiny), "response"), 5).collect()}
    assert "response|a|c|t1,t3,t5|0.600" in lines
    assert {tuple(r) for r in differences(spark.createDataFrame([("a",), ("a",)], "line string"), spark.createDataFrame([("a",), ("b",)], "line string")).collect()} == {("first", "a"), ("second", "b")}
