import itertools
import random
from collections import Counter

from traceloom.llm.pairs import activity_baskets, associated, cooccurrences


def _brute(rows):
    baskets: dict = {}
    for b, i, *_ in rows:
        if b is not None:
            baskets.setdefault(b, set()).update({i} - {None})
    n, pairs = Counter(), Counter()
    for s in baskets.values():
        n.update(s)
        pairs.update(itertools.combinations(sorted(s), 2))
    return len(baskets), n, pairs


def test_blocks_against_counting(spark):
    rnd = random.Random(1)
    rows = [(f"b{rnd.randrange(30)}", f"i{rnd.randrange(12)}", 1) for _ in range(400)] + [("huge", f"i{k}", 1) for k in range(90)] + [(None, "i1", 1), ("lone", None, 1), ("b1", None, 1)]
    df = spark.createDataFrame(rows, "basket string, item string, n int")
    total, n, pairs = _brute(rows)
    for block in (256, 8, 1):
        got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_all) for r in cooccurrences(df, block=block).collect()}
        assert got == {p: (k, n[p[0]], n[p[1]], total) for p, k in pairs.items()}
    some = {(r.item_a, r.item_b) for r in cooccurrences(df, 5, 0.1).collect()}
    assert some == {p for p, k in pairs.items() if k >= max(5, 0.1 * total)}
    high = {(r.item_a, r.item_b) for r in associated(cooccurrences(df), 2).collect()}
    assert high == {p for p, k in pairs.items() if k * total >= 2 * n[p[0]] * n[p[1]]}


def test_empty(spark):
    df = spark.createDataFrame([], "basket string, item string")
    assert cooccurrences(df).count() == 0


def test_activity_baskets(spark):
    rows = spark.createDataFrame([("r", "Sign Deed", None, "t"), ("r", "sign deed", "File Map", "t"), ("r", None, None, "u"), ("r", "x", "y", None)], "rule string, event_a string, event_b string, trace string")
    cat = spark.createDataFrame([("Sign Deed",), ("File Map",)], "event_type string")
    assert {(r.basket, r["item"]) for r in activity_baskets(rows, cat).collect()} == {("t", "Sign Deed"), ("t", None), ("t", "File Map"), ("u", None)}
