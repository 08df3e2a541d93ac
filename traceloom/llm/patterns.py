"""Frequent subsequences across many sequences, gaps allowed, from closed patterns.

Traces are dealt by hash into shards of a bounded number of events. In every shard the closed patterns are mined item by item: the search starts from each
first item and grows over pseudo-projections (a sequence and the position where its first match ends). A pattern is closed if no item can be
added after it, before it or inside it without losing traces (checked in both directions), and the search is cut where an item
could always have been inserted earlier. The shard's closed patterns give back the local support of every pattern frequent there, of the lengths
asked for. A pattern frequent over all traces is frequent in some shard, at the same share, so these are all candidates; those frequent in every shard
are counted by then, the others, if what is known leaves them a chance, in one more pass.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.session import broadcast_if_bounded, collect_bounded, materialize

#: Events of frequent types per shard, on average.
SHARD = 500_000
#: Events of frequent types beyond which a trace is set aside and matched by joins, in chunks of so many positions.
LONG, CHUNK = 32_768, 65_536
#: Traces set aside, at most, as a share of the least support; with more the whole log is mined level by level, by joins.
FEW = 0.5
#: Most frequent items, and most candidate patterns, that the driver holds.
ITEMS, CANDIDATES = 100_000, 1_000_000
#: Items up to which a worker counts their pairs in a table; with more the search just tries each item.
PAIRED = 4_000


class Miner:
    """Closed patterns of sequences of whole numbers with at least ``least`` sequences each."""

    def __init__(self, seqs: list[list[int]], least: float):
        self.seqs, self.least = seqs, least
        self.closed: dict[tuple, int] = {}
        #: item -> sequence -> its positions
        self.places: dict[int, dict[int, list[int]]] = {}
        for i, s in enumerate(seqs):
            for j, x in enumerate(s):
                at = self.places.setdefault(x, {})
                if i in at:
                    at[i].append(j)
                else:
                    at[i] = [j]

    def run(self) -> dict[tuple, int]:
        first = sorted(x for x, at in self.places.items() if len(at) >= self.least)
        every = set(first)
        self._follows = self._pairs(first) if len(first) <= PAIRED else dict.fromkeys(first, every)
        for x in first:
            at = [(i, p[0] + 1) for i, p in self.places[x].items()]
            if not self._insertable((x,), at, False):
                self._grow((x,), at, every)
        return self.closed

    def _pairs(self, items: list[int]) -> dict[int, set[int]]:
        """For each item those that follow it in enough sequences: a comes before b if a's first place is before b's last."""
        code = {x: k for k, x in enumerate(items)}
        rows = [(i, code[x], p[0], p[-1]) for x in items for i, p in self.places[x].items()]
        if not rows:
            return {}
        t = np.array(rows, np.int64)
        t = t[np.argsort(t[:, 0], kind="stable")]
        seq, n = np.unique(t[:, 0], return_counts=True)
        start = np.cumsum(n) - n
        counts = np.zeros(len(items) ** 2, np.int64)
        for lo in range(0, len(seq), 4096):
            m, st = n[lo : lo + 4096], start[lo : lo + 4096]
            own = np.repeat(np.arange(st[0], st[-1] + m[-1]), np.repeat(m, m))
            size = np.repeat(m, m)
            other = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(np.repeat(st, m), size)
            ok = t[own, 2] < t[other, 3]
            counts += np.bincount(t[own, 1][ok] * len(items) + t[other, 1][ok], minlength=len(counts))
        out: dict[int, set[int]] = {x: set() for x in items}
        for k in np.flatnonzero(counts >= self.least).tolist():
            out[items[k // len(items)]].add(items[k % len(items)])
        return out

    def _step(self, at: list[tuple[int, int]], x: int) -> list[tuple[int, int]]:
        """The projection one step further: in which sequences x comes at or after the given places, and where the first such x ends."""
        places, out = self.places[x], []
        for i, p in at:
            have = places.get(i)
            if have is not None and have[-1] >= p:
                out.append((i, (have[0] if have[0] >= p else have[bisect_left(have, p)]) + 1))
        return out

    def _grow(self, pattern: tuple, at: list[tuple[int, int]], items: set[int]) -> None:
        nxt = {}
        for x in sorted(items & self._follows[pattern[-1]]):
            e = self._step(at, x)
            if len(e) >= self.least:
                nxt[x] = e
        if not any(len(e) == len(at) for e in nxt.values()) and not self._insertable(pattern, at, True):
            self.closed[pattern] = len(at)
        for x, e in nxt.items():
            if not self._insertable((*pattern, x), e, False):
                self._grow((*pattern, x), e, set(nxt))

    def _insertable(self, pattern: tuple, at: list[tuple[int, int]], whole: bool) -> bool:
        """Whether some item stands before the same step of the pattern in every sequence.

        ``whole``: between the first match of the steps before and the last place the step can take in the sequence (closedness); otherwise
        the last place it can take within the first match (then nothing closed starts with this pattern).
        """
        n = len(pattern)
        common: list[set | None] = [None] * n
        alive = set(range(n))
        for i, end in at:
            s = self.seqs[i]
            firsts, j = [], 0
            for x in pattern:
                j = s.index(x, j) + 1
                firsts.append(j)
            stop = len(s) if whole else end
            for k in range(n - 1, -1, -1):
                stop -= 1
                while s[stop] != pattern[k]:
                    stop -= 1
                if k in alive:
                    have = set(s[firsts[k - 1] if k else 0 : stop])
                    common[k] = have if common[k] is None else common[k] & have
                    if not common[k]:
                        alive.discard(k)
            if not alive:
                return False
        return True

    def counts(self, patterns: list[tuple]) -> list[int]:
        """In how many sequences each pattern occurs; patterns with a common start share its projection."""
        out = [0] * len(patterns)
        trie = prefix_tree(patterns)

        def walk(node: dict, at: list[tuple[int, int]] | None) -> None:
            for x, (k, below) in node.items():
                if x not in self.places:
                    continue
                e = [(i, p[0] + 1) for i, p in self.places[x].items()] if at is None else self._step(at, x)
                if k is not None:
                    out[k] = len(e)
                if e and below:
                    walk(below, e)

        walk(trie, None)
        return out


def prefix_tree(patterns: list[tuple]) -> dict:
    """item -> [number of the pattern that ends here or None, tree below]."""
    root: dict = {}
    for k, p in enumerate(patterns):
        node = root
        for x in p[:-1]:
            node = node.setdefault(x, [None, {}])[1]
        node.setdefault(p[-1], [None, {}])[0] = k
    return root


def subpatterns(patterns: Iterable[tuple], shortest: int = 1, longest: int | None = None, distinct: bool = False) -> set[tuple]:
    """The different subsequences of ``shortest`` to ``longest`` steps; ``distinct``: only those without repeated steps."""
    out: set[tuple] = set()
    for p in patterns:
        for q in _subsequences(p, shortest, longest or len(p), distinct):
            out.add(q)
            if len(out) > CANDIDATES:
                raise ValueError(f"more than {CANDIDATES} candidate patterns; raise the support or ask for shorter ones")
    return out


def _subsequences(p: tuple, shortest: int, longest: int, distinct: bool) -> Iterator[tuple]:
    """Each different subsequence once: every step is taken at its first place after the step before."""
    after: list[dict] = [{}]
    for i in range(len(p) - 1, -1, -1):
        after.append({**after[-1], p[i]: i + 1})
    after.reverse()
    todo: list[tuple[tuple, int]] = [((), 0)]
    while todo:
        q, i = todo.pop()
        if len(q) >= shortest:
            yield q
        if len(q) < longest:
            todo.extend(((*q, x), j) for x, j in after[i].items() if not (distinct and x in q))


def recover(closed: dict[tuple, int], shortest: int = 1, longest: int | None = None, distinct: bool = False) -> dict[tuple, int]:
    """The support of every frequent pattern, from the closed ones: the greatest of those that contain it."""
    out: dict[tuple, int] = {}
    for p, n in sorted(closed.items(), key=lambda x: -x[1]):
        for q in _subsequences(p, max(1, shortest), longest or len(p), distinct):
            if q not in out:
                out[q] = n
                if len(out) > CANDIDATES:
                    raise ValueError(f"more than {CANDIDATES} frequent patterns; raise the support or ask for shorter ones")
    return out


class _Places:
    """The events ``(trace, pos, id)`` of long traces, to find the first place of an item after a position.

    A trace's events of an item may be many: they are met in chunks of positions, later chunks by their first place only.
    """

    def __init__(self, events: DataFrame):
        self.events = events.select("trace", "id", F.floor(F.col("pos") / F.lit(CHUNK)).alias("chunk"), "pos")
        self.firsts = materialize(self.events.groupBy("trace", "id", "chunk").agg(F.min("pos").alias("pos")))

    def start(self, table: DataFrame) -> DataFrame:
        """``(trace, node, k, end)`` of the nodes ``(node, id, k)``."""
        hits = self.firsts.join(table, "id")
        return materialize(hits.groupBy("trace", "node", "k").agg(F.min("pos").alias("end")))

    def step(self, at: DataFrame, table: DataFrame) -> DataFrame:
        """The same for the nodes ``(node, parent, id, k)`` one step below."""
        here = at.select("trace", F.col("node").alias("parent"), F.col("end").alias("_from")).join(table, "parent")
        here = here.withColumn("_chunk", F.floor(F.col("_from") / F.lit(CHUNK)))
        inside = self.events.withColumnRenamed("chunk", "_chunk").join(here, ["trace", "id", "_chunk"]).where("pos > _from")
        later = self.firsts.join(here, ["trace", "id"]).where("chunk > _chunk")
        hits = inside.select("trace", "node", "k", "pos").unionByName(later.select("trace", "node", "k", "pos"))
        return materialize(hits.groupBy("trace", "node", "k").agg(F.min("pos").alias("end")))


NODES = "node int, parent int, id int, k int"


def _long_counts(events: DataFrame, patterns: list[tuple]) -> dict[int, int]:
    """In how many of the long traces ``(trace, pos, id)`` each pattern occurs.

    Level by level over the tree of patterns: a trace's first match of a longer start ends at the first place of its last item after the
    shorter start's end. Equi-joins and one aggregation a level; a trace's events are never brought together.
    """
    spark = events.sparkSession
    nodes: list[list[tuple[int, int, int, int]]] = []
    todo = [(-1, prefix_tree(patterns))]
    number = 0
    while todo:
        level, below_all = [], []
        for parent, tree in todo:
            for x, (k, below) in tree.items():
                level.append((number, parent, x, -1 if k is None else k))
                if below:
                    below_all.append((number, below))
                number += 1
        nodes.append(level)
        todo = below_all
    out: dict[int, int] = {}
    places, at = _Places(events), None
    for level in nodes:
        table = broadcast_if_bounded(spark.createDataFrame(level, NODES))
        at = places.start(table) if at is None else places.step(at, table)
        for r in at.where("k >= 0").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect():  # at most the candidates
            out[r.k] = r.n
    return out


def _by_levels(events: DataFrame, least: float, items: int, longest: int | None, distinct: bool) -> dict[tuple, int]:
    """All frequent patterns of events ``(trace, pos, id)`` up to ``longest`` steps, by joins alone: for logs of mostly long traces.

    A pattern is tried if it is frequent without its first and without its last step.
    """
    spark = events.sparkSession
    places, at = _Places(events), None
    out: dict[tuple, int] = {}
    level = [(-1, (x,)) for x in range(items)]
    while level:
        if len(level) + len(out) > CANDIDATES:
            raise ValueError(f"more than {CANDIDATES} candidate patterns; raise the support or ask for shorter ones")
        table = broadcast_if_bounded(spark.createDataFrame([(i, parent, p[-1], i) for i, (parent, p) in enumerate(level)], NODES))
        at = places.start(table) if at is None else places.step(at, table)
        counted = at.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()  # at most the candidates
        kept = {level[r.k][1]: (r.k, r.n) for r in counted}
        out |= {p: n for p, (_, n) in kept.items()}
        if longest and len(level[0][1]) >= longest:
            break
        ends: dict[tuple, list[int]] = {}
        for p in kept:
            ends.setdefault(p[:-1], []).append(p[-1])
        level = [(k, (*p, x)) for p, (k, _) in sorted(kept.items()) for x in sorted(ends.get(p[1:], ())) if not (distinct and x in p)]
    return out


def frequent_counts(
    log: DataFrame, support: float, shortest: int = 1, longest: int | None = None, distinct: bool = False, shard: int = SHARD, long: int = LONG
) -> tuple[dict[tuple, int], int]:
    """``({(event types…): traces}, number of traces)``: the frequent patterns of ``shortest`` to ``longest`` steps of a log ``(trace, event_type, pos)``.

    A pattern counts once per trace and is kept if at least ``support`` of all traces have it. Rows with a null in any of the three columns are left out;
    the order of rows with equal (trace, pos) is by type. Other columns are ignored; an empty log has no patterns. A few traces may hold most
    events: traces of more than ``long`` events are not mined but only matched with the candidates, which are found with as many traces less. Where
    such traces are not few, the log is mined level by level by joins. The frequent patterns themselves, not the data, have to fit the driver;
    their number is checked.
    """
    spark = log.sparkSession
    rows = materialize(log.select("trace", "event_type", "pos").dropna())
    per = materialize(rows.groupBy("trace", "event_type").agg(F.count(F.lit(1)).alias("c")))
    n = per.select("trace").distinct().count()
    if not n:
        return {}, 0
    least = support * n - 1e-9
    frequent = sorted(r[0] for r in collect_bounded(per.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("event_type"), ITEMS, "frequent items"))
    if not frequent:
        return {}, n
    named = lambda kept: {tuple(frequent[i] for i in p): c for p, c in kept.items() if len(p) >= shortest}
    names = F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(frequent)], "event_type string, id int"))  # bounded by ITEMS
    events = rows.join(names, "event_type").select("trace", "pos", "id")
    sizes = materialize(per.join(names, "event_type").groupBy("trace").agg(F.sum("c").alias("n")))
    over = sizes.where(F.col("n") > long).select("trace")
    tally = sizes.agg(F.count_if(F.col("n") > long).alias("h"), F.sum(F.when(F.col("n") <= long, F.col("n"))).alias("events"), F.count_if(F.col("n") <= long).alias("total")).first()
    h, total = tally.h, tally.total
    if h > FEW * least:
        return named(_by_levels(materialize(events), least, len(frequent), longest, distinct)), n
    apart = broadcast_if_bounded(materialize(over)) if h else None
    ordinary = events.join(apart, "trace", "left_anti") if h else events
    shards = max(1, math.ceil((tally.events or 0) / shard))
    seqs = ordinary.groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("s"))
    parts = materialize(seqs.select(F.pmod(F.xxhash64("trace"), F.lit(shards)).cast("int").alias("shard"), F.col("s.id").alias("items")))
    share = max(least - h, 1) / max(total, 1)
    local = parts.groupBy("shard").applyInArrow(_mine(share, shortest, longest, distinct), "pattern array<int>, n bigint, size bigint")
    local = local.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    # where it was not frequent a pattern has fewer than that share of the shard's traces
    hopeful = local.where(F.col("n") + F.lit(share) * (F.lit(total) - F.col("size")) >= F.lit(least - h))
    cand = {tuple(r.pattern): (r.n, r.size) for r in collect_bounded(materialize(hopeful), CANDIDATES, "candidate patterns")}
    exact = {p: c for p, (c, size) in cand.items() if size == total and c >= least - h}
    open_ = sorted(p for p, (_, size) in cand.items() if size < total)
    if open_:
        counted = parts.groupBy("shard").applyInArrow(_count(open_), "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= least - h)
        exact |= {open_[r.k]: r.n for r in counted.collect()}  # at most the candidates
    if h and exact:
        order = sorted(exact)
        more = _long_counts(materialize(events.join(apart, "trace", "left_semi")), order)
        exact = {p: exact[p] + more.get(i, 0) for i, p in enumerate(order)}
    return named({p: c for p, c in exact.items() if c >= least}), n


def closed_patterns(log: DataFrame, support: float, **kw) -> tuple[dict[tuple, int], int]:
    """Closed patterns of any length ``{(event types…): traces}`` and the number of traces; see ``frequent_counts``."""
    every, n = frequent_counts(log, support, **kw)
    return _closed(every), n


def _closed(every: dict[tuple, int]) -> dict[tuple, int]:
    """Those patterns of ``every`` that lose traces with any step added."""
    shorter: dict[tuple, int] = {}
    for p, c in every.items():
        for i in range(len(p)):
            q = p[:i] + p[i + 1 :]
            shorter[q] = max(shorter.get(q, 0), c)
    return {p: c for p, c in every.items() if shorter.get(p) != c}


def _lists(table: pa.Table) -> list[list[int]]:
    return [x for chunk in table.column("items").chunks for x in chunk.to_pylist()]


def _mine(share: float, shortest: int, longest: int | None, distinct: bool):
    def run(table: pa.Table) -> pa.Table:
        seqs = _lists(table)
        found = recover(Miner(seqs, max(1.0, share * len(seqs) - 1e-6)).run(), shortest, longest, distinct)
        return pa.table({"pattern": pa.array([list(p) for p in found], pa.list_(pa.int32())), "n": pa.array(list(found.values()), pa.int64()), "size": pa.array([len(seqs)] * len(found), pa.int64())})

    return run


def _count(cand: list[tuple]):
    def run(table: pa.Table) -> pa.Table:
        counts = Miner(_lists(table), 1).counts(cand)
        some = [(k, c) for k, c in enumerate(counts) if c]
        return pa.table({"k": pa.array([k for k, _ in some], pa.int32()), "n": pa.array([c for _, c in some], pa.int64())})

    return run


def frequent_patterns(log: DataFrame, support: float, shortest: int = 1, longest: int | None = None, distinct: bool = False, closed: bool = True, **kw) -> DataFrame:
    """``(steps, n_traces, support, closed)``: all frequent patterns of ``shortest`` to ``longest`` steps; ``distinct``: without repeated steps.

    ``closed`` False leaves the last column out, and with it the counting of patterns one step longer.
    """
    if closed:
        every, n = frequent_counts(log, support, shortest, longest + 1 if longest else None, **kw)
        marked = _closed(every)
    else:
        every, n = frequent_counts(log, support, shortest, longest, distinct, **kw)
        marked = {}
    kept = [(p, c) for p, c in sorted(every.items()) if len(p) <= (longest or len(p)) and not (distinct and len(set(p)) < len(p))]
    out = log.sparkSession.createDataFrame([(list(p), c, c / n, p in marked) for p, c in kept], "steps array<string>, n_traces bigint, support double, closed boolean")
    return out if closed else out.drop("closed")
