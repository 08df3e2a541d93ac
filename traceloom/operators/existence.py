"""Existence rules: how often an activity occurs in a trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.facts import Facts
from traceloom.session import BROADCAST_ROWS, at_most

RULES = ("exactly", "existence", "absence")


def instances(f: Facts) -> DataFrame:
    """``(event_a, instances, trace)``: the number of occurrences, at least 1."""
    return f.st.select(F.col("event_type").alias("event_a"), F.col("c").alias("instances"), "trace")


def existence_counts(f: Facts, *rules: str) -> DataFrame:
    """``(rule, event_a, instances, n_traces)`` for the observed numbers k of each activity, all rules from one aggregation.

    exactly: traces with k occurrences. existence: at least k. absence: fewer than k, also none; k goes to one more than the greatest
    observed number, where it holds for all traces. Rows that hold in no trace are left out.
    """
    exact = f.st.groupBy(F.col("event_type").alias("event_a"), F.col("c").alias("instances")).agg(F.count(F.lit(1)).alias("n"))
    return from_exact(exact, f.n, *rules)


def from_exact(exact: DataFrame, n_all: DataFrame, *rules: str) -> DataFrame:
    """``existence_counts`` from the counts of ``exactly`` ``(event_a, instances, n)`` and the number of traces."""
    w = Window.partitionBy("event_a").orderBy(F.desc("instances"))
    more = exact.select("event_a", "instances", "n", F.sum("n").over(w).alias("at_least"), (F.row_number().over(w) == 1).alias("top")).crossJoin(F.broadcast(n_all))
    item = lambda rule, k, n: F.struct(F.lit(rule).alias("rule"), k.alias("instances"), n.alias("n_traces"))
    k = F.col("instances")
    items = {
        "exactly": [item("exactly", k, F.col("n"))],
        "existence": [item("existence", k, F.col("at_least"))],
        "absence": [item("absence", k, F.col("n_all") - F.col("at_least")), item("absence", F.when(F.col("top"), k + 1), F.col("n_all"))],
    }
    long = more.select("event_a", F.explode(F.array(*[x for r in rules for x in items[r]])).alias("_x"))
    return long.select("_x.rule", "event_a", "_x.instances", "_x.n_traces").where("n_traces > 0 and instances is not null")


def existence_rows(f: Facts, rule: str) -> DataFrame:
    """``(rule, event_a, instances, trace)``: the traces behind ``existence_counts``."""
    have = instances(f)
    if rule == "exactly":
        got = have
    else:
        marks = have.select("event_a", F.col("instances").alias("k")).distinct()
        if rule == "existence":
            got = have.join(marks, "event_a").where("instances >= k").select("event_a", F.col("k").alias("instances"), "trace")
        else:
            marks = marks.unionByName(have.groupBy("event_a").agg((F.max("instances") + 1).alias("k")))
            every = F.broadcast(at_most(marks, BROADCAST_ROWS, "numbers of occurrences of activities")).crossJoin(f.traces)
            got = (
                every.join(have, ["event_a", "trace"], "left").where("instances is null or instances < k").select("event_a", F.col("k").alias("instances"), "trace")
            )
    return got.select(F.lit(rule).alias("rule"), "event_a", "instances", "trace")
