"""Branching: merging the targets (or sources) of a rule into sets under OR, AND or XOR.

No group collects its traces. A trace matters to the greedy merge only through the set of operands it holds, so the rows of a group are
first condensed to a histogram ``operand set -> number of traces`` (two aggregations with map-side combining); complement rules get theirs from the
sets of types of the traces, without any row per trace and pair. Coverage sizes of unions, intersections and symmetric differences are sums over that
histogram; the merge runs on it as arrays, one group per call, up to a checked size of the histogram. Operands are taken in lexicographic
order and the first best wins. Chain rules are merged along the rows of their base rule; there the coverages are kept as rows and all groups
advance together, one join and one count per step.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators import ordered, unordered
from traceloom.operators.facts import Facts
from traceloom.session import materialize

#: Members of all operand sets of one group, at most: what one call of the merge holds.
MEMBERS = 20_000_000
#: Operand sets turned into a matrix at a time.
ROWS = 4096
POLICIES = ("OR", "AND", "XOR")


def signatures(rows: DataFrame, group: list[str], operand: str) -> DataFrame:
    """``(group…, operands, n)``: for each set of operands, the traces of the group that hold exactly these."""
    sets = rows.groupBy(*group, "trace").agg(F.sort_array(F.collect_set(operand)).alias("operands"))
    return sets.groupBy(*group, "operands").agg(F.count(F.lit(1)).alias("n"))


def complements(f: Facts, rule: str, side: str) -> DataFrame:
    """``(rule, fixed, operands, n)``: the histogram of a rule that holds where others do not, without its rows.

    Unordered rules depend only on which types a trace has: traces are counted by their set of types, and each different set gives the operands
    of every type. The operands of not-succession are those of response that a trace lacks.
    """
    if rule == "not-succession":
        rows = ordered.ordered_rows(f, "response")
        fixed, operand = ("event_a", "event_b") if side.upper() == "TARGET" else ("event_b", "event_a")
        long = rows.select(F.col(fixed).alias("fixed"), F.col(operand).alias("operand"), "trace")
        held = materialize(signatures(long, ["fixed"], "operand"))
        whole = held.select("fixed", F.explode("operands").alias("o")).distinct().groupBy("fixed").agg(F.sort_array(F.collect_list("o")).alias("whole"))
        some = held.join(whole, "fixed").select("fixed", F.array_except("whole", "operands").alias("operands"), "n")
        rest = held.groupBy("fixed").agg(F.sum("n").alias("some")).join(whole, "fixed").crossJoin(F.broadcast(f.n))
        every = some.unionByName(rest.select("fixed", F.col("whole").alias("operands"), (F.col("n_all") - F.col("some")).alias("n")))
        every = every.where((F.size("operands") > 0) & (F.col("n") > 0))
    else:
        sets = materialize(unordered.trace_sets(f).groupBy("have").agg(F.count(F.lit(1)).alias("n")))
        each = sets.crossJoin(F.broadcast(unordered.type_list(f))).select("have", "types", "n", F.explode("types").alias("fixed"))
        has, own = F.array_contains("have", F.col("fixed")), F.col("fixed")
        if side.upper() == "TARGET":
            holds = lambda y: unordered.HOLDS[rule](has, F.array_contains("have", y), own, y)
        else:
            holds = lambda x: unordered.HOLDS[rule](F.array_contains("have", x), has, x, own)
        every = each.select("fixed", F.filter("types", holds).alias("operands"), "n").where(F.size("operands") > 0)
    return every.groupBy(F.lit(rule).alias("rule"), "fixed", "operands").agg(F.sum("n").alias("n"))


class Histogram:
    """Operand sets and their numbers of traces as arrays; operands are numbered in order."""

    def __init__(self, sets: list, n: list):
        self.operands = sorted(set().union(*sets)) if len(sets) else []
        code = {x: i for i, x in enumerate(self.operands)}
        self.n = np.asarray(n, np.int64)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.row = np.repeat(np.arange(len(sets)), self.sizes)
        self.code = np.array([code[x] for s in sets for x in s], np.int64)
        by = np.argsort(self.code, kind="stable")
        #: rows of each operand
        self.rows = np.split(self.row[by], np.cumsum(np.bincount(self.code, minlength=len(self.operands)))[:-1]) if self.operands else []

    @classmethod
    def of(cls, pairs) -> Histogram:
        return pairs if isinstance(pairs, cls) else cls([s for s, _ in pairs], [n for _, n in pairs])

    def hits(self, chosen) -> np.ndarray:
        """How many of the chosen operands each set has."""
        out = np.zeros(len(self.n), np.int64)
        for x in chosen:
            out[self.rows[x]] += 1
        return out

    def singles(self, weight: np.ndarray) -> np.ndarray:
        """The sum of weights over the sets of each operand."""
        return np.bincount(self.code, weights=weight[self.row], minlength=len(self.operands)).astype(np.int64)

    def together(self) -> np.ndarray:
        """The traces that each two operands share."""
        k = len(self.operands)
        out = np.zeros((k, k))
        edge = np.concatenate([[0], np.cumsum(self.sizes)])
        for lo in range(0, len(self.n), ROWS):
            hi = min(lo + ROWS, len(self.n))
            m = np.zeros((hi - lo, k))
            m[self.row[edge[lo] : edge[hi]] - lo, self.code[edge[lo] : edge[hi]]] = 1
            out += m.T @ (m * self.n[lo:hi, None])
        return np.rint(out).astype(np.int64)

    def covered(self, policy: str, chosen) -> int:
        hits = self.hits(chosen)
        held = hits > 0 if policy == "OR" else hits == len(chosen) if policy == "AND" else hits % 2 == 1
        return int(self.n[held].sum())

    def named(self, chosen) -> list:
        return [self.operands[x] for x in sorted(chosen)]


def covered(policy: str, chosen: set, histogram) -> int:
    """The traces that a set of operands covers."""
    h = Histogram.of(histogram)
    code = {x: i for i, x in enumerate(h.operands)}
    if policy == "AND" and any(x not in code for x in chosen):
        return 0
    return h.covered(policy, [code[x] for x in chosen if x in code])


class _Left:
    """Operands of an OR merge that are left: what each covers alone, and what all cover. Dropping all of them costs one pass over the sets."""

    def __init__(self, h: Histogram):
        self.h = h
        k = len(h.operands)
        self.alive = np.ones(k, bool)
        self.count = h.sizes.copy()
        self.total = np.bincount(h.row, weights=h.code, minlength=len(h.n)).astype(np.int64)  # of the codes left in a set: the code itself where one is left
        one = self.count == 1
        self.own = np.bincount(self.total[one], weights=h.n[one], minlength=k).astype(np.int64)
        self.size = int(h.n[self.count > 0].sum())

    def weakest(self) -> int:
        return int(np.argmin(np.where(self.alive, self.own, np.iinfo(np.int64).max)))

    def drop(self, x: int) -> None:
        rows = self.h.rows[x]
        self.size -= int(self.h.n[rows[self.count[rows] == 1]].sum())
        self.count[rows] -= 1
        self.total[rows] -= x
        alone = rows[self.count[rows] == 1]
        np.add.at(self.own, self.total[alone], self.h.n[alone])
        self.alive[x] = False

    def chosen(self) -> np.ndarray:
        return np.flatnonzero(self.alive)


def merge_or(histogram, bound: int, threshold: float, drop_factor: float) -> tuple[list, int]:
    """Drops the operand with the least own coverage, down to ``bound`` (bound > 0), or else as long as the loss is no outlier."""
    h = Histogram.of(histogram)
    left = _Left(h)
    k = len(h.operands)
    if bound > 0:
        for _ in range(k - bound):
            left.drop(left.weakest())
        return h.named(left.chosen()), left.size
    valid, losses, size = left.chosen(), [], left.size
    for _ in range(k - 1):
        x = left.weakest()
        loss = int(left.own[x])
        losses.append(loss)
        mean = sum(losses) / len(losses)
        sigma = max(0.0, sum(y * y for y in losses) / len(losses) - mean * mean) ** 0.5
        if left.size == 0 or (threshold > 0 and left.size <= threshold) or abs(loss - mean) > drop_factor * sigma + 1e-9:
            break
        valid, size = left.chosen(), left.size
        left.drop(x)
    return h.named(valid), size


def merge_sets(policy: str, histogram, bound: int, threshold: float, drop_rare: bool) -> tuple[list, int]:
    """AND and XOR: the best pair, extended by the best operand each time.

    Bounded: up to ``bound`` operands, while extensions keep at least two traces. Unbounded: an extension is taken only if it keeps
    the coverage size. ``drop_rare`` starts from operands that touch a trace with the most operands of the group.
    """
    h = Histogram.of(histogram)
    first = np.arange(len(h.operands))
    if drop_rare and len(h.n):
        first = np.unique(h.code[(h.sizes == h.sizes.max())[h.row]])
    if not len(first):
        return [], 0
    if len(first) == 1:
        return h.named(first), h.covered(policy, first)
    both, alone = h.together()[np.ix_(first, first)], h.singles(h.n)[first]
    sizes = both if policy == "AND" else alone[:, None] + alone[None, :] - 2 * both
    sizes = np.where(np.triu(np.ones_like(sizes, bool), 1), sizes, -1)
    i, j = divmod(int(np.argmax(sizes)), len(first))
    best, now = [int(first[i]), int(first[j])], int(sizes[i, j])

    def extension() -> tuple[int, int]:
        """``(traces, operand)`` of the best further operand with more than one trace; the first of equals."""
        hits = h.hits(best)
        if policy == "AND":
            got = h.singles(np.where(hits == len(best), h.n, 0))
        else:
            odd = hits % 2 == 1
            got = int(h.n[odd].sum()) + h.singles(np.where(odd, -h.n, h.n))
        got[best] = -1
        x = int(np.argmax(got))
        return (int(got[x]), x) if got[x] > 1 else (-1, -1)

    if bound > 1:
        while len(best) < bound and now > 0 and not (threshold > 0 and now <= threshold):
            top, x = extension()
            if top < 0 or (threshold > 0 and top <= threshold):
                break
            best, now = [*best, x], top
        return h.named(best), now
    if now == 0:
        x = int(np.argmax(alone))
        return h.named([first[x]]), int(alone[x])
    while now > threshold and now > (1 if policy == "AND" else 0):
        top, x = extension()
        if top != now:
            break
        best = [*best, x]
    return h.named(best), now


def branch(
    rows: DataFrame | None, f: Facts, options, support: float = 0.0, side: str | None = None, base: DataFrame | None = None, condensed: DataFrame | None = None
) -> DataFrame:
    """``(rule, side, fixed, merged, n_traces, support)`` for the rows ``(rule, event_a, event_b, trace)`` of one rule.

    side TARGET merges ``event_b`` for each ``event_a``, SOURCE the reverse; rows without an ``event_b`` (position rules) merge their activities
    for the whole rule. ``base``: rows of the base rule of a chain rule, used by AND and XOR. ``condensed``: the histogram (``complements``) in place of rows.
    A group whose operand sets have more than ``MEMBERS`` members in all is refused.
    """
    policy = options.policy.upper()
    if policy not in POLICIES:
        raise ValueError(f"unsupported branching policy {options.policy}")
    side = (side or options.side).upper()
    if side not in ("TARGET", "SOURCE"):
        raise ValueError(f"unsupported branching side {side}")
    bounded = options.bound > (1 if side == "TARGET" else 0)
    bound = max(options.bound, 1) if bounded else 0
    facts_n = f.n
    long = None
    if rows is not None:
        single = F.col("event_b").isNull()
        if side == "TARGET":
            fixed, operand = F.when(~single, F.col("event_a")), F.when(single, F.col("event_a")).otherwise(F.col("event_b"))
        else:
            fixed, operand = F.when(~single, F.col("event_b")), F.col("event_a")
        long = rows.select("rule", fixed.alias("fixed"), operand.alias("operand"), "trace")
    if base is not None and policy != "OR":
        got = _chain(long, base, policy, bound, options.drop_rare, support, facts_n)
    else:
        sig = materialize(condensed if condensed is not None else signatures(long, ["rule", "fixed"], "operand"))
        large = sig.groupBy("rule", "fixed").agg(F.sum(F.size("operands")).alias("m")).where(F.col("m") > MEMBERS).limit(1).collect()
        if large:
            raise ValueError(f"the operand sets of {large[0].fixed} under {large[0].rule} have more than {MEMBERS} members; branch fewer activities")
        drop_factor, drop_rare = options.drop_factor, options.drop_rare

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            histogram = Histogram(list(pdf.operands), list(pdf.n))
            limit = support * int(pdf.n_all.iloc[0])
            if policy == "OR":
                chosen, n = merge_or(histogram, bound, limit, drop_factor)
            else:
                chosen, n = merge_sets(policy, histogram, 2 if bound == 1 else bound, limit, drop_rare)
            return pd.DataFrame({"rule": [pdf.rule.iloc[0]], "fixed": [pdf.fixed.iloc[0]], "merged": [",".join(chosen)], "size": [len(chosen)], "n_traces": [n]})

        got = sig.crossJoin(F.broadcast(facts_n)).groupBy("rule", "fixed").applyInPandas(merge, "rule string, fixed string, merged string, size int, n_traces bigint")
    if options.exact_bound and options.bound > 0:
        got = got.where(F.col("size") == options.bound)
    return (
        got.crossJoin(F.broadcast(facts_n))
        .withColumn("support", F.col("n_traces") / F.col("n_all"))
        .where((F.col("n_traces") > 0) & (F.col("support") > F.lit(support)))
        .select("rule", F.lit(side).alias("side"), "fixed", "merged", "n_traces", "support")
    )


def _chain(long: DataFrame, base: DataFrame, policy: str, bound: int, drop_rare: bool, support: float, n: DataFrame) -> DataFrame:
    """Chain rules under AND or XOR: from an operand K to an operand L of a base row K -> L, then on from L.

    The coverage of a merge is a set of (group, trace) rows. Each step counts all candidates of all groups at once, ranks them per group
    and keeps the winner's rows. Unbounded merging ends when no group grows any more, after one step per activity at most.
    """
    g = ["rule", "fixed"]
    if drop_rare:
        hits = long.groupBy(*g, "trace").agg(F.countDistinct("operand").alias("h"))
        top = hits.withColumn("m", F.max("h").over(Window.partitionBy(*g))).where("h = m").select(*g, "trace")
        long = long.join(long.join(top, [*g, "trace"], "left_semi").select(*g, "operand").distinct(), [*g, "operand"], "left_semi")
    links = base.select(F.col("event_a").alias("tail"), F.col("event_b").alias("next"), "trace").distinct()
    per_operand = long.groupBy(*g, "operand").agg(F.count(F.lit(1)).alias("size"))
    only = Window.partitionBy(*g)
    singles = per_operand.withColumn("k", F.count(F.lit(1)).over(only)).where("k = 1").select(*g, F.col("operand").alias("merged"), F.lit(1).alias("size_"), F.col("size").alias("n_traces"))
    many = long.join(singles.select(*g), g, "left_anti")
    cover = many.select(*g, F.array("operand").alias("members"), F.col("operand").alias("tail"), "trace")
    done = singles.select(*g, "merged", F.col("size_").alias("size"), "n_traces")
    limit = n.select((F.lit(support) * F.col("n_all")).alias("_limit"))
    current = None
    for step in range(2, bound + 1) if bound > 1 else itertools.count(2):
        cand = _extend(cover, links, policy, g)
        sizes = cand.groupBy(*g, "members", "tail").agg(F.count(F.lit(1)).alias("sz"))
        rank = Window.partitionBy(*g).orderBy(F.desc("sz"), "members")
        best = sizes.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")
        if step > 2:
            keep = best.join(current.select(*g, F.col("n_traces").alias("old"), F.col("size").alias("had")), g).crossJoin(F.broadcast(limit))
            best = keep.where("sz > _limit" if bound > 1 else "sz = old and sz > _limit and size(members) > had").select(*g, "members", "tail", "sz")
        fresh = best.select(*g, F.array_join(F.array_sort("members"), ",").alias("merged"), F.size("members").alias("size"), F.col("sz").alias("n_traces"))
        if current is None:
            current = fresh
        else:
            current = fresh.unionByName(current.join(fresh.select(*g), g, "left_anti"))
        cover = materialize(cand.join(best.select(*g, "members", "tail"), [*g, "members", "tail"], "left_semi"))
        current = materialize(current)
        if cover.isEmpty():
            break
    return done.unionByName(current)


def _extend(cover: DataFrame, links: DataFrame, policy: str, g: list[str]) -> DataFrame:
    """Coverage rows of every extension of every cover by one base row that starts at its tail."""
    options = cover.select(*g, "members", "tail").distinct().join(links.select("tail", "next").distinct(), "tail")
    own = cover.join(options, [*g, "members", "tail"])
    if policy == "AND":
        rows = own.join(links, ["tail", "next", "trace"], "left_semi")
    else:
        other = options.join(links, ["tail", "next"])
        cols = [*g, "members", "tail", "next", "trace"]
        rows = own.select(*cols).unionByName(other.select(*cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("_k")).where("_k = 1")
    grown = F.when(F.array_contains("members", F.col("next")), F.col("members")).otherwise(F.concat("members", F.array("next")))
    return rows.select(*g, grown.alias("members"), F.col("next").alias("tail"), "trace")
