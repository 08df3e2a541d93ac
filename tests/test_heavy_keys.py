import random
from collections import Counter, defaultdict

from traceloom.operators.heavy_keys import heavy_keys, key_counts, key_lists


def _rows(seed=2, n=3000):
    rnd = random.Random(seed)
    return [("f", rnd.choice([None, *"hhhhhhhhhabc"]), rnd.choice([None, "x", *(f"t{i}" for i in range(200))]), 1) for _ in range(n)] + [("g", "z", None, 2)] * 3 + [("g", "h", "one", 2)] * 500


def test_counts_lists_and_shares(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, k string, v string, _salt int")
    n, values = Counter(), defaultdict(set)
    for g, k, v, _ in rows:
        n[g, k] += 1
        if v is not None:
            values[g, k].add(v)
    for parts in (1, 7, 40):
        got = {(r.g, r.k): (r.n_rows, r.n_values) for r in key_counts(df, ["g", "k"], "v", parts).collect()}
        assert got == {x: (n[x], len(values[x])) for x in n}
        lists = defaultdict(list)
        for r in key_lists(df, ["g", "k"], "v", 16, parts).orderBy("g", "k", "part", "part_no").collect():
            assert 0 < len(r["values"]) <= 16
            lists[r.g, r.k] += r["values"]
        assert dict(lists) == {x: sorted(s) for x, s in values.items() if s}
    heavy = {(r.g, r.k) for r in heavy_keys(df, ["g"], "k", "v", 0.3).collect()}
    assert heavy == {("f", "h"), ("g", "h")}


def test_empty(spark):
    df = spark.createDataFrame([], "g string, k string, v string")
    assert key_counts(df, ["g", "k"], "v").count() == 0 and key_lists(df, ["g", "k"], "v").count() == 0 and heavy_keys(df, ["g"], "k", "v", 0.1).count() == 0


def test_other_types(spark):
    df = spark.createDataFrame([(1, 2.5), (1, 2.5), (1, 3.5), (2, None)], "k bigint, v double")
    assert sorted(map(tuple, key_counts(df, ["k"], "v", 3).collect())) == [(1, 3, 2), (2, 1, 0)]


def test_one_pair_of_key_and_value_with_most_rows(spark):
    """More partitions than any fixed salt would fill."""
    from pyspark.sql import functions as F

    from traceloom.operators.heavy_keys import _parted

    df = spark.range(200_000).selectExpr("'k' as k", "if(id % 50 = 0, cast(id as string), 'v') as v")
    spread = _parted(df, ["k"], "v", 150).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) > 120 and max(r["count"] for r in spread) < 6_000
    assert [tuple(r) for r in key_counts(df, ["k"], "v", 150).collect()] == [("k", 200_000, 4_001)]
