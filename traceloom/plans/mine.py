"""Mining: the options of a run as one declarative plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators import existence, ordered, position, unordered
from traceloom.operators.facts import Facts, build_facts

FAMILIES = {"position": position.RULES, "existence": existence.RULES, "unordered": unordered.RULES, "ordered": ordered.RULES}
#: From more rules than this the facts are stored once instead of being computed for each.
SEVERAL = 2
ALL_RULES = tuple(r for rules in FAMILIES.values() for r in rules)


@dataclass(frozen=True)
class Branching:
    """policy OR, AND or XOR; side TARGET or SOURCE; bound 0 is unbounded."""

    policy: str
    side: str = "TARGET"
    bound: int = 0
    drop_factor: float = 1.5
    drop_rare: bool = False
    exact_bound: bool = False


def family(rule: str) -> str:
    for name, rules in FAMILIES.items():
        if rule in rules:
            return name
    raise ValueError(f"unknown rule {rule}")


def rule_rows(f: Facts, rule: str) -> DataFrame:
    """``(rule, event_a, event_b, trace)`` of any rule; ``event_b`` is null for position rules and the number k, as a string, for existence rules."""
    kind = family(rule)
    if kind == "position":
        return position.position_rows(f, rule).select("rule", "event_a", F.lit(None).cast("string").alias("event_b"), "trace")
    if kind == "existence":
        return existence.existence_rows(f, rule).select("rule", "event_a", F.col("instances").cast("string").alias("event_b"), "trace")
    return unordered.unordered_rows(f, rule) if kind == "unordered" else ordered.ordered_rows(f, rule)


def rule_counts(f: Facts, *rules: str) -> DataFrame:
    """``(rule, event_a, event_b, n_traces)``: the supports of rules, without trace lists; each family in one pass."""
    parts = []
    for kind, names in FAMILIES.items():
        some = [r for r in rules if r in names]
        if not some:
            continue
        if kind == "position":
            rows = reduce(DataFrame.unionByName, [rule_rows(f, r) for r in some])
            parts.append(rows.groupBy("rule", "event_a", "event_b").agg(F.count(F.lit(1)).alias("n_traces")))
        elif kind == "existence":
            parts.append(existence.existence_counts(f, *some).select("rule", "event_a", F.col("instances").cast("string").alias("event_b"), "n_traces"))
        else:
            parts.append(unordered.unordered_counts(f, *some) if kind == "unordered" else ordered.ordered_counts(f, *some))
    if unknown := [r for r in rules if r not in ALL_RULES]:
        raise ValueError(f"unknown rules {unknown}")
    return reduce(DataFrame.unionByName, parts)


def with_support(counts: DataFrame, f: Facts, support: float = 0.0) -> DataFrame:
    """Adds ``support`` = traces / all traces and keeps the rows above the threshold (strictly)."""
    return (
        counts.crossJoin(F.broadcast(f.n))  # one row
        .withColumn("support", F.col("n_traces") / F.col("n_all"))
        .where(F.col("support") > F.lit(support))
        .drop("n_all")
    )


def mine(log: DataFrame, rules: list[str] | None = None, support: float = 0.0, branching: Branching | None = None, facts: Facts | None = None) -> DataFrame:
    """Mines a log ``(trace, event_type, pos)``.

    Without branching: ``(rule, event_a, event_b, n_traces, support)``. With branching: ``(rule, side, fixed, merged, n_traces, support)`` where
    ``merged`` joins the merged activities with commas; of the existence rules only ``exactly`` is branched, always by SOURCE.
    """
    chosen = list(rules or ALL_RULES)
    f = facts or build_facts(log, keep=len(chosen) > SEVERAL, neighbours=any("chain" in r for r in chosen))
    if branching is None or not branching.policy:
        return with_support(rule_counts(f, *chosen), f, support)
    from traceloom.operators.branching import branch, complements

    parts = []
    for r in chosen:
        if family(r) == "existence" and r != "exactly":
            continue
        side = "SOURCE" if family(r) == "existence" else branching.side
        condensed = complements(f, r, side) if r in unordered.HOLDS or r == "not-succession" else None
        rows = rule_rows(f, r) if condensed is None else None
        parts.append(branch(rows, f, branching, support, side=side, base=ordered_base(f, r), condensed=condensed))
    return reduce(DataFrame.unionByName, parts)


def ordered_base(f: Facts, rule: str) -> DataFrame | None:
    """The rows along which a chain rule is merged: those of the rule named after ``chain-``."""
    return ordered.ordered_rows(f, rule.split("chain-")[1]) if "chain-" in rule else None
