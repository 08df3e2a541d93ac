"""Unordered rules: which activities share traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.facts import Facts
from traceloom.session import ACTIVITIES, at_most

RULES = ("responded existence", "co-existence", "not co-existence", "choice", "exclusive choice")


def both_rows(f: Facts) -> DataFrame:
    """``(event_a, event_b, trace)``: both occur, a = b included."""
    a = f.st.select("trace", F.col("event_type").alias("event_a"))
    b = f.st.select("trace", F.col("event_type").alias("event_b"))
    return a.join(b, "trace")


def pair_counts(f: Facts) -> DataFrame:
    """``(event_a, event_b, n_a, n_b, n_ab, n_all)`` over the whole activity matrix, from two aggregations."""
    n = f.st.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return from_both(n, both_rows(f).groupBy("event_a", "event_b").agg(F.count(F.lit(1)).alias("n_ab")), f.n)


def from_both(n: DataFrame, both: DataFrame, n_all: DataFrame) -> DataFrame:
    """``pair_counts`` from the traces of each type ``(event_type, n)``, of pairs that meet ``(event_a, event_b, n_ab)``, and all."""
    n = at_most(n, ACTIVITIES, "activities")
    matrix = (
        n.select(F.col("event_type").alias("event_a"), F.col("n").alias("n_a"))
        .crossJoin(F.broadcast(n.select(F.col("event_type").alias("event_b"), F.col("n").alias("n_b"))))
        .crossJoin(F.broadcast(n_all))
    )
    return matrix.join(both, ["event_a", "event_b"], "left").withColumn("n_ab", F.coalesce("n_ab", F.lit(0).cast("bigint")))


#: rule -> (pairs it is stated for, number of traces)
FORMULAS = {
    "responded existence": ("true", "n_ab"),
    "co-existence": ("true", "n_all - n_a - n_b + 2 * n_ab"),
    "not co-existence": ("true", "case when event_a < event_b then n_all - n_ab else n_all - n_a - n_b + n_ab end"),
    "choice": ("event_a < event_b", "n_a + n_b - n_ab"),
    "exclusive choice": ("event_a < event_b", "n_a + n_b - 2 * n_ab"),
}


def unordered_counts(f: Facts, *rules: str) -> DataFrame:
    """``(rule, event_a, event_b, n_traces)`` by inclusion and exclusion, all rules from one matrix; rows that hold in no trace are left out."""
    return from_matrix(pair_counts(f), *rules)


def from_matrix(matrix: DataFrame, *rules: str) -> DataFrame:
    items = [f"struct('{r}' as rule, case when {where} then {n} else 0 end as n_traces)" for r, (where, n) in ((r, FORMULAS[r]) for r in rules)]
    long = matrix.selectExpr("event_a", "event_b", f"explode(array({', '.join(items)})) as _x")
    return long.select("_x.rule", "event_a", "event_b", "_x.n_traces").where("n_traces > 0")


#: rule -> whether it holds, of (a occurs, b occurs, a, b)
HOLDS = {
    "co-existence": lambda a, b, x, y: a == b,
    "not co-existence": lambda a, b, x, y: F.when(x < y, ~(a & b)).otherwise(~a & ~b),
    "choice": lambda a, b, x, y: (x < y) & (a | b),
    "exclusive choice": lambda a, b, x, y: (x < y) & (a != b),
}


def trace_sets(f: Facts) -> DataFrame:
    """``(trace, have)``: the types of each trace, in order."""
    return f.st.groupBy("trace").agg(F.sort_array(F.collect_set("event_type")).alias("have"))


def type_list(f: Facts) -> DataFrame:
    """One row: all types in order; an error beyond ``ACTIVITIES``."""
    return at_most(f.types, ACTIVITIES, "activities").agg(F.sort_array(F.collect_list("event_type")).alias("types"))


def unordered_rows(f: Facts, rule: str) -> DataFrame:
    """``(rule, event_a, event_b, trace)``: the traces behind ``unordered_counts``, for trace lists.

    Other than of ``responded existence`` there are as many as traces times pairs of types; branching goes by ``branching.complements`` instead.
    """
    if rule == "responded existence":
        got = both_rows(f)
    else:
        each = trace_sets(f).crossJoin(F.broadcast(type_list(f))).select("trace", "have", "types", F.explode("types").alias("event_a"))
        holds = lambda y: HOLDS[rule](F.array_contains("have", F.col("event_a")), F.array_contains("have", y), F.col("event_a"), y)
        got = each.select("trace", "event_a", F.explode(F.filter("types", holds)).alias("event_b"))
    return got.select(F.lit(rule).alias("rule"), "event_a", "event_b", "trace")
