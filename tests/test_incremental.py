import datetime as dt
import random

import pytest

from traceloom.plans.incremental import MiningState, affected_events, new_events, trace_bounds
from traceloom.plans.mine import mine
from traceloom.streaming.stream import mine_stream

SCHEMA = "trace string, event_type string, ts timestamp_ntz, pos int"


def _log(seed=4):
    rnd = random.Random(seed)
    return [(f"t{i}", rnd.choice("abcd"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(3) + p * 5), p) for i in range(25) for p in range(rnd.randint(1, 8))]


def _result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_equal_the_whole(spark, tmp_path):
    rows = _log()
    rnd = random.Random(1)
    batches = [[], [], []]
    for r in rows:  # late events too: a position may come before an earlier one
        batches[min(2, r[3] // 3 if rnd.random() < 0.8 else rnd.randrange(3))].append(r)
    state = MiningState(spark, str(tmp_path / "s"))
    for b in batches:
        state.update(spark.createDataFrame(b, SCHEMA))
    before = state.version
    assert state.update(spark.createDataFrame([], SCHEMA)) == before
    state.update(spark.createDataFrame(batches[1], SCHEMA))  # delivered twice
    whole = mine(spark.createDataFrame(rows, SCHEMA))
    assert _result(state.mine()) == _result(whole)
    hard = MiningState(spark, str(tmp_path / "s"))
    hard.update(spark.createDataFrame([], SCHEMA), hard=True)
    assert _result(hard.mine()) == _result(whole)
    assert state.metadata.events == len(rows) and state.metadata.has_previous_stored


def test_cut_is_strict_and_semi_join_takes_whole_traces(spark):
    df = spark.createDataFrame(_log(), SCHEMA)
    cut = "2024-01-01 12:00:00"
    fresh = new_events(df, cut)
    assert fresh.where("ts <= timestamp_ntz'2024-01-01 12:00:00'").count() == 0
    assert new_events(df, None).count() == df.count() == new_events(df, cut, hard=True).count()
    touched = {r.trace for r in trace_bounds(fresh).collect()}
    assert {r.trace for r in affected_events(df, trace_bounds(fresh)).collect()} == touched


def test_stream_equals_batch(spark, tmp_path):
    rows = _log(8)
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(2):
        df.where(f"pos % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = mine_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert not q.isActive
    assert _result(MiningState(spark, str(tmp_path / "state")).mine(rules=["response", "choice"])) == _result(mine(df, ["response", "choice"]))


@pytest.mark.parametrize("args", [[], ["-l", "x", "-s", "2"], ["-l", "x", "-p", "NOR"], ["-l", "x", "-b", "-1"]])
def test_bad_arguments(args):
    from traceloom.plans.cli import parse

    with pytest.raises(ValueError):
        parse(args)


def test_cli_run(spark, tmp_path):
    from traceloom.plans.cli import parse, run

    (tmp_path / "log.txt").write_text("t1::a/delab/2024-01-01 00:00:00,b/delab/2024-01-01 01:00:00\nt2::a/delab/2024-01-01 00:00:00\n")
    path = run(spark, parse(["-l", str(tmp_path / "log.txt"), "-f", "text", "-o", str(tmp_path), "-s", "0.4"]))
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert "response|a|b|1|0.500" in lines and "first|a|2|1.000" in lines
    branched = run(spark, parse(["-l", str(tmp_path / "log.txt"), "-f", "text", "-o", str(tmp_path), "-p", "or", "-b", "2"]))
    assert "p_OR" not in branched and branched.endswith("b2_pOR.txt")


class Stopped(Exception):
    pass


def test_a_stop_between_any_two_steps_loses_nothing(spark, tmp_path):
    rows = _log(3)
    first, second = [r for r in rows if r[3] < 4], [r for r in rows if r[3] >= 3]
    want_first, want = _result(mine(spark.createDataFrame(first, SCHEMA), ["response", "absence"])), _result(mine(spark.createDataFrame(rows, SCHEMA), ["response", "absence"]))
    folder = str(tmp_path / "s")
    MiningState(spark, folder).update(spark.createDataFrame(first, SCHEMA))
    steps: list[str] = []

    class Stops(MiningState):
        at = -1

        def _at(self, step):
            steps.append(step)
            if len(steps) - 1 == self.at:
                raise Stopped(step)

    k = 0
    while True:
        state = Stops(spark, folder)
        state.at = k
        steps.clear()
        try:
            state.update(spark.createDataFrame(second, SCHEMA))
            break
        except Stopped:
            assert state.version == 1 and _result(state.mine(["response", "absence"])) == want_first
            k += 1
    assert k == len(steps) >= 6 and "replaced" in steps
    state = MiningState(spark, folder)
    assert state.version == 2 and _result(state.mine(["response", "absence"])) == want
    state.vacuum(keep=1)
    assert state.version == 2 and _result(state.mine(["response", "absence"])) == want
    assert _result(state.log) == _result(spark.createDataFrame(rows, SCHEMA))


def test_segments_are_merged_and_only_touched_traces_are_read(spark, tmp_path, monkeypatch):
    import traceloom.plans.incremental as m

    monkeypatch.setattr(m, "COMPACT", 2)
    rows = _log(6)
    state = MiningState(spark, str(tmp_path / "s"))
    for k in range(4):
        state.update(spark.createDataFrame([r for r in rows if r[3] % 4 == k], SCHEMA))
        assert len(state.manifest()["segments"]) <= 2
    whole = mine(spark.createDataFrame(rows, SCHEMA))
    assert _result(state.mine()) == _result(whole)
    by_rows = mine(state.log, facts=state.facts)
    assert _result(by_rows) == _result(whole)


def test_object_store_settings_and_environment():
    from traceloom.session import object_store, required

    got = object_store("http://store:9000", "k", "s")
    assert got["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000" and got["spark.hadoop.fs.s3a.path.style.access"] == "true" and got["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert required("A", {"A": "x"}) == "x"
    with pytest.raises(ValueError, match="set B"):
        required("B", {"A": "x"})


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from traceloom.session import at_most, broadcast_if_bounded

    df = spark.range(100).withColumn("s", F.lit("x" * 1000))
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower() or "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_bounded(df)) and not hinted(broadcast_if_bounded(df, rows=99)) and not hinted(broadcast_if_bounded(df, size=90_000))
    assert at_most(df, 100, "rows").count() == 100
    with pytest.raises(Exception, match="more than 99 rows"):
        at_most(df, 99, "rows").collect()


def test_cli_lists(spark, tmp_path):
    from traceloom.plans.cli import parse, run

    (tmp_path / "log.txt").write_text("t1::a/delab/2024-01-01 00:00:00,b/delab/2024-01-01 01:00:00\nt2::a/delab/2024-01-01 00:00:00\n")
    lines = [r[0] for r in spark.read.text(run(spark, parse(["-l", str(tmp_path / "log.txt"), "-f", "text", "-o", str(tmp_path), "-s", "0.4", "-i"]))).collect()]
    assert "response|a|b|t1|0.500" in lines and "first|a|t1,t2|1.000" in lines
