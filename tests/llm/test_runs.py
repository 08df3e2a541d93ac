import datetime as dt
import itertools
import random

from traceloom.llm.runs import collapse_runs

SCHEMA = "trace string, event_type string, ts timestamp_ntz, pos int, _n int"
T = dt.datetime(2024, 1, 1)


def _brute(rows):
    out = []
    for t, g in itertools.groupby(sorted((r for r in rows if None not in (r[0], r[1], r[3])), key=lambda r: (r[0], r[3])), key=lambda r: r[0]):
        for e, run in itertools.groupby(g, key=lambda r: r[1]):
            run = list(run)
            a, b = run[0][2], run[-1][2]
            out.append((t, e, run[0][3], run[-1][3], len(run), a, b, None if a is None or b is None else (b - a).total_seconds()))
    return sorted(out, key=str)


def test_against_grouping(spark):
    rnd = random.Random(2)
    rows = []
    for t in ("x", "y", "z"):
        for p in sorted(rnd.sample(range(-5, 120), 70)):
            rows.append((t, rnd.choice("aab"), None if rnd.random() < 0.1 else T + dt.timedelta(seconds=rnd.randrange(100)), p, 0))
    rows += [(None, "a", T, 1, 0), ("x", None, T, 500, 0), ("x", "a", T, None, 0), ("w", "a", None, 7, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (1, 3, 10, 100_000):
        assert sorted(map(tuple, collapse_runs(df, chunk).collect()), key=str) == _brute(rows)


def test_one_long_run(spark):
    df = spark.createDataFrame([("t", "a", T, p, 0) for p in range(50)], SCHEMA)
    assert [(r.first_pos, r.last_pos, r.n_events) for r in collapse_runs(df, 7).collect()] == [(0, 49, 50)]
    assert collapse_runs(df.limit(0), 7).count() == 0
