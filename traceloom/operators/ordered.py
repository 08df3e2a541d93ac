"""Ordered rules: what follows or precedes what inside a trace.

All closed forms rest on the per-type facts and on one count: ``alternations(A, B)``, how many gaps between consecutive As (the open
gap after the last A included) hold a B. Gaps before Bs that hold an A are equally many, so ``alternate-response`` is
``alternations = count(A)`` and ``alternate-precedence`` is ``alternations = count(B)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators import blocks
from traceloom.operators.facts import Facts
from traceloom.session import ACTIVITIES, at_most

RULES = (
    "response", "precedence", "succession", "alternate-response", "alternate-precedence", "alternate-succession",
    "chain-response", "chain-precedence", "chain-succession", "not-succession", "not-chain-succession",
)

def alternations(f: Facts, block: int = blocks.BLOCK, span: int = blocks.SPAN) -> DataFrame:
    """``(event_a, event_b, trace, g)`` for A other than B and g > 0; see ``blocks.alternations``."""
    return blocks.alternations(f.occ, block, span)


def _pairs(f: Facts) -> DataFrame:
    x = f.st.select("trace", F.col("event_type").alias("event_a"), F.col("c").alias("c_a"), F.col("mn").alias("mn_a"))
    y = f.st.select("trace", F.col("event_type").alias("event_b"), F.col("c").alias("c_b"), F.col("mn").alias("mn_b"), F.col("mx").alias("mx_b"))
    return x.join(y, "trace")


def ordered_rows(f: Facts, rule: str) -> DataFrame:
    """``(rule, event_a, event_b, trace)``: the traces in which the rule holds for the pair.

    response: some A strictly before some B. precedence: the first A before the first B (A = B: at least two). succession: equal to
    precedence, which implies response. alternate-*: see the module. chain-*: every A is directly followed (every B directly preceded) by
    the other; never A = B. not-chain-succession: alternate-response without chain-response. not-succession: all traces without
    response, for pairs with a response somewhere.
    """
    cols = ["event_a", "event_b", "trace"]
    if rule == "response":
        got = _pairs(f).where("mn_a < mx_b")
    elif rule in ("precedence", "succession"):
        got = _pairs(f).where("(event_a <> event_b and mn_a < mn_b) or (event_a = event_b and c_a >= 2)")
    elif rule in ("alternate-response", "alternate-precedence", "alternate-succession"):
        alt = f.once("alternations", lambda: alternations(f)).join(_pairs(f).where("event_a <> event_b"), cols)
        want = {"alternate-response": "g = c_a", "alternate-precedence": "g = c_b", "alternate-succession": "g = c_a and g = c_b"}[rule]
        got = alt.where(want)
        if rule == "alternate-precedence":
            twice = f.st.where("c >= 2").select(F.col("event_type").alias("event_a"), F.col("event_type").alias("event_b"), "trace")
            got = got.select(*cols).unionByName(twice)
    elif rule == "chain-response":
        got = _chain_response(f)
    elif rule == "chain-precedence":
        got = _chain_precedence(f)
    elif rule == "chain-succession":
        got = _chain_response(f).join(_chain_precedence(f), cols, "left_semi")
    elif rule == "not-chain-succession":
        got = ordered_rows(f, "alternate-response").join(_chain_response(f), cols, "left_anti")
    elif rule == "not-succession":
        held = ordered_rows(f, "response").select(*cols)
        every = f.traces.crossJoin(F.broadcast(at_most(held.select("event_a", "event_b").distinct(), ACTIVITIES * 10, "pairs of activities")))
        got = every.join(held, cols, "left_anti")
    else:
        raise ValueError(f"unknown ordered rule {rule}")
    return got.select(F.lit(rule).alias("rule"), *cols)


def _chain_response(f: Facts) -> DataFrame:
    only = f.st.where("n_next = c and min_next = max_next and min_next <> event_type")
    return only.select(F.col("event_type").alias("event_a"), F.col("min_next").alias("event_b"), "trace")


def _chain_precedence(f: Facts) -> DataFrame:
    only = f.st.where("n_prev = c and min_prev = max_prev and min_prev <> event_type")
    return only.select(F.col("min_prev").alias("event_a"), F.col("event_type").alias("event_b"), "trace")


#: rule -> condition on a row of the pair table
FLAGS = {
    "response": "true",
    "precedence": "prec",
    "succession": "prec",
    "alternate-response": "alt_r",
    "alternate-precedence": "alt_p or (event_a = event_b and prec)",
    "alternate-succession": "alt_r and alt_p",
    "chain-response": "ch_r",
    "chain-precedence": "ch_p",
    "chain-succession": "ch_r and ch_p",
    "not-chain-succession": "alt_r and not ch_r",
}


def pair_table(f: Facts, alternate: bool = True, chain: bool = True) -> DataFrame:
    """``(event_a, event_b, trace, prec, alt_r, alt_p, ch_r, ch_p)`` of all pairs with a response: every ordered rule implies one."""
    only = lambda side: f"case when n_{side} = c and min_{side} = max_{side} then min_{side} end" if chain else "cast(null as string)"
    x = f.st.selectExpr("trace", "event_type as event_a", "c as c_a", "mn as mn_a", f"{only('next')} as only_next")
    y = f.st.selectExpr("trace", "event_type as event_b", "c as c_b", "mn as mn_b", "mx as mx_b", f"{only('prev')} as only_prev")
    rows = x.join(y, "trace").where("mn_a < mx_b")
    differ = F.col("event_a") != F.col("event_b")
    if alternate:
        rows = rows.join(f.once("alternations", lambda: alternations(f)), ["event_a", "event_b", "trace"], "left")
    else:
        rows = rows.withColumn("g", F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False)) & differ
    return rows.select(
        "event_a", "event_b", "trace", F.when(differ, F.col("mn_a") < F.col("mn_b")).otherwise(F.col("c_a") >= 2).alias("prec"),
        yes(F.col("g") == F.col("c_a")).alias("alt_r"), yes(F.col("g") == F.col("c_b")).alias("alt_p"),
        yes(F.col("only_next") == F.col("event_b")).alias("ch_r"), yes(F.col("only_prev") == F.col("event_a")).alias("ch_p"),
    )


def pairs_for(f: Facts, rules) -> DataFrame:
    """``pair_table`` with what the rules need."""
    return pair_table(f, any("alt" in FLAGS[r] for r in rules), any("ch_" in FLAGS[r] for r in rules))


def ordered_counts(f: Facts, *rules: str) -> DataFrame:
    """``(rule, event_a, event_b, n_traces)`` of the rules, all from one pass over the pairs.

    not-succession is all traces minus those with response, without its trace lists.
    """
    base = [r for r in rules if r in FLAGS]
    if "not-succession" in rules and "response" not in base:
        base.append("response")
    sums = [F.count_if(F.expr(FLAGS[r])).alias(f"_{i}") for i, r in enumerate(base)]
    wide = pairs_for(f, base).groupBy("event_a", "event_b").agg(*sums).crossJoin(F.broadcast(f.n))
    items = [F.struct(F.lit(r).alias("rule"), F.col(f"_{i}").alias("n_traces")) for i, r in enumerate(base) if r in rules]
    if "not-succession" in rules:
        items.append(F.struct(F.lit("not-succession").alias("rule"), (F.col("n_all") - F.col(f"_{base.index('response')}")).alias("n_traces")))
    long = wide.select("event_a", "event_b", F.explode(F.array(*items)).alias("_x"))
    return long.select("_x.rule", "event_a", "event_b", "_x.n_traces").where("n_traces > 0")
