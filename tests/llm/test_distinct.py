import random

from traceloom.llm.distinct import ERROR_BOUND, STANDARD_ERROR, estimate, low_diversity, merge, sketch


def test_error_does_not_depend_on_the_scale(spark):
    for n in (1, 10, 1000, 20_000, 400_000):
        df = spark.range(24 * n).selectExpr("id % 24 as g", "concat('v', id) as v")
        errors = [r.n_distinct / n - 1 for r in estimate(sketch(df, ["g"], "v"), ["g"]).collect()]
        assert len(errors) == 24 and max(map(abs, errors)) < ERROR_BOUND
        assert (sum(e * e for e in errors) / 24) ** 0.5 < 1.5 * STANDARD_ERROR


def test_merging_is_or(spark):
    df = spark.range(60_000).selectExpr("id % 7 as day", "id % 3 as rule", "cast(id % 9000 as string) as v")
    fine = sketch(df, ["day", "rule"], "v")
    for group in (["day"], ["rule"], []):
        key = lambda r: tuple(r)
        assert sorted(map(key, merge(fine, group).collect())) == sorted(map(key, sketch(df, group, "v").collect()))
    assert abs(estimate(merge(fine, []), []).first()[0] / 9000 - 1) < ERROR_BOUND


def test_low_diversity_is_exact_near_the_limit(spark):
    rnd = random.Random(1)
    rows = []
    for g in range(40):
        n = 400
        d = rnd.choice([n // 2 - 1, n // 2, n // 2 + 1, n // 10, n])
        rows += [(f"g{g}", f"v{g}-{i % d}") for i in range(n)]
    rows += [(None, "x"), ("g0", None)]
    df = spark.createDataFrame(rows, "g string, v string")
    want = {g for g in {r[0] for r in rows if r[0]} if len({v for k, v in rows if k == g and v}) < 0.5 * sum(k == g and v is not None for k, v in rows)}
    assert {r.g for r in low_diversity(df, ["g"], "v", 0.5).collect()} == want
    assert low_diversity(df.limit(0), ["g"], "v", 0.5).count() == 0
    assert estimate(sketch(df.limit(0), ["g"], "v"), ["g"]).count() == 0
