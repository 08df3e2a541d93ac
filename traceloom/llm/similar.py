"""All similar pairs between sets by recursive chosen-path splitting.

Equal sets are folded into one class first, so copies never meet. Every tree starts with all classes in one node. A record moves from its node
into one child for each of its tokens whose hash with the node is small: about ``branch / threshold`` children. Two similar sets share
about ``branch`` of them at least, whatever the number of records, and dissimilar ones hardly any. Nodes of few records are compared
outright; larger ones are split again. Independent trees are repeated to reach the target recall, whatever the number of levels. Candidates pass a size
test and a 64-bit minwise sketch, then their whole sets are compared, as 64-bit hashes of their members.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from traceloom.session import broadcast_if_bounded, materialize

#: Records up to which a node is compared outright.
LEAF = 64
#: Shared children of a pair at the threshold, per level and tree.
BRANCH = 1.6
#: Records of a class that are paired in one place; larger classes are paired in blocks of so many.
TOGETHER = 1024
#: Wrong rejections by the sketch: a pair at the threshold is lost with a chance of about 3e-5 (four standard deviations).
SKETCH_DEVIATIONS = 4.0
_A = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(8).integers(0, 2**63, 64, dtype=np.uint64)


def trees_for(recall: float, branch: float = BRANCH) -> int:
    """Trees after which a pair at the threshold was met with the chance ``recall``, however many levels are needed.

    The chance to meet in a tree falls with each level towards the fixed point of x = 1 - exp(-branch x).
    """
    if branch <= 1:
        raise ValueError("with a branch of 1 or less pairs are lost with every level")
    met = 1.0
    for _ in range(200):
        met = 1 - math.exp(-branch * met)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rep, members)`` of each different set and ``(id, rep)``; the class id is its smallest record id. Empty and null sets are left out."""
    kept = sets.where(F.col("id").isNotNull() & F.col("members").isNotNull())
    clean = kept.select("id", F.array_sort(F.array_distinct(F.filter("members", lambda x: x.isNotNull()))).alias("members")).where(F.size("members") > 0)
    keyed = clean.withColumn("_key", F.sha2(F.array_join(F.transform("members", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ","), 256))
    keyed = materialize(keyed)
    # one row per set before anything is moved, however many copies there are
    first = materialize(keyed.groupBy("_key").agg(F.min("id").alias("rep"), F.min_by("members", "id").alias("members")))
    membership = keyed.select("id", "_key").distinct().join(broadcast_if_bounded(first.select("_key", "rep")), "_key").select("id", "rep")
    return first.select("rep", "members"), membership


@F.pandas_udf(LongType())
def minwise_bits(tokens: pd.Series) -> pd.Series:
    """64 one-bit minwise hashes of each list of 64-bit tokens (lists are not empty)."""
    lens = np.fromiter((len(x) for x in tokens), dtype=np.int64, count=len(tokens))
    if not len(lens):
        return pd.Series([], dtype="int64")
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in tokens]).view(np.uint64)
    at = np.concatenate([[0], np.cumsum(lens)[:-1]])
    out = np.zeros(len(lens), dtype=np.uint64)
    for i in range(64):
        h = flat * _A[i] + _B[i]
        h ^= h >> np.uint64(32)
        h *= _A[63 - i]
        out |= ((np.minimum.reduceat(h, at) >> np.uint64(17)) & np.uint64(1)) << np.uint64(i)
    return pd.Series(out.view(np.int64))


def class_pairs(reps: DataFrame, threshold: float, recall: float = 0.9999, leaf: int = LEAF, branch: float = BRANCH, max_depth: int = 24) -> DataFrame:
    """``(rep_a, rep_b, similarity)``: pairs of different sets ``(rep, members)`` with a Jaccard similarity of at least ``threshold``.

    Each pair at the threshold is met with a chance of at least ``recall`` (less 3e-5 for the sketch), more similar ones surer. Reported pairs are compared
    in whole, member by member, as 64-bit hashes: two sets of a million members each have one wrongly equal hash with a chance of 5e-8.
    A pair's smaller set travels to the larger one, which is not moved for each of its pairs.
    A node still large at ``max_depth`` holds records that agree almost everywhere; it is compared in blocks of ``leaf`` records.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    base = reps.select("rep", F.size("members").alias("size"), F.transform("members", lambda x: F.xxhash64(x)).alias("tokens"))
    base = materialize(base.select("rep", "size", "tokens", minwise_bits("tokens").alias("bits")))
    trees = trees_for(recall, branch)
    nodes = None
    found: list[DataFrame] = []
    chance = F.least(F.lit(1.0), F.lit(branch / threshold) / F.col("size"))
    for depth in range(1, max_depth + 1):
        if nodes is None:
            spread = base.select("rep", "size", "bits", F.explode("tokens").alias("_t")).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(trees).cast("bigint"))).alias("node"))
        else:
            spread = nodes.join(base, "rep").select("rep", "size", "bits", "node", F.explode("tokens").alias("_t"))
        mixed = spread.withColumn("_h", F.xxhash64("node", "_t"))
        chosen = mixed.where(F.abs(F.col("_h").cast("double")) / F.lit(2.0**63) < chance).select("rep", "size", "bits", F.xxhash64("_h", F.lit(depth)).alias("node"))
        here = materialize(chosen)
        sizes = here.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
        big = materialize(sizes.where(F.col("_n") > leaf))
        hint = broadcast_if_bounded(big)
        found.append(_within(here.join(hint, "node", "left_anti"), threshold))
        if big.isEmpty():
            nodes = None
            break
        nodes = here.join(hint.select("node"), "node", "left_semi").select("rep", "node")
    if nodes is not None:
        found.append(_blocks(nodes.join(base.drop("tokens"), "rep"), big, threshold, leaf))
    cand = found[0]
    for f in found[1:]:
        cand = cand.unionByName(f)
    cand = cand.distinct()
    whole = base.select("rep", "tokens")
    low = F.col("sx") <= F.col("sy")
    ends = cand.select("rep_a", "rep_b", F.when(low, F.col("rep_a")).otherwise(F.col("rep_b")).alias("_small"), F.when(low, F.col("rep_b")).otherwise(F.col("rep_a")).alias("_large"))
    moved = ends.join(whole.select(F.col("rep").alias("_small"), F.col("tokens").alias("_ts")), "_small")
    met = moved.join(whole.select(F.col("rep").alias("_large"), F.col("tokens").alias("_tl")), "_large")
    shared = F.size(F.array_intersect("_ts", "_tl"))
    union = F.size("_ts") + F.size("_tl") - shared
    return met.select("rep_a", "rep_b", (shared / union).alias("similarity"), shared.alias("_s"), union.alias("_u")).where(F.col("_s") >= F.lit(threshold) * F.col("_u") - 1e-9).drop("_s", "_u")


def _near(threshold: float) -> str:
    """The size test and the sketch test on rows x and y."""
    agree = (1 + threshold) / 2 * 64
    least = agree - SKETCH_DEVIATIONS * math.sqrt(64 * (1 + threshold) / 2 * (1 - threshold) / 2)
    return f"sx >= {threshold} * sy - 1e-9 and sy >= {threshold} * sx - 1e-9 and 64 - bit_count(bx ^ by) >= {math.floor(least)}"


def _within(rows: DataFrame, threshold: float) -> DataFrame:
    x = rows.select("node", F.col("rep").alias("rep_a"), F.col("size").alias("sx"), F.col("bits").alias("bx"))
    y = rows.select("node", F.col("rep").alias("rep_b"), F.col("size").alias("sy"), F.col("bits").alias("by"))
    return x.join(y, "node").where("rep_a < rep_b").where(_near(threshold)).select("rep_a", "rep_b", "sx", "sy")


def _blocks(rows: DataFrame, sizes: DataFrame, threshold: float, leaf: int) -> DataFrame:
    """All pairs of large nodes in blocks: each record meets every block of its node, the blocks' pairs are spread over tasks."""
    cut = rows.join(sizes, "node").withColumn("_k", F.ceil(F.col("_n") / leaf).cast("int")).withColumn("_b", F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int"))
    wide = cut.withColumn("_o", F.explode(F.expr("sequence(0, _k - 1)")))
    side = wide.select("node", F.least("_b", "_o").alias("g"), F.greatest("_b", "_o").alias("k"), F.col("_b").alias("h"), "rep", "size", "bits")
    x = side.select("node", "g", "k", F.col("h").alias("hx"), F.col("rep").alias("rep_a"), F.col("size").alias("sx"), F.col("bits").alias("bx"))
    y = side.select("node", "g", "k", F.col("h").alias("hy"), F.col("rep").alias("rep_b"), F.col("size").alias("sy"), F.col("bits").alias("by"))
    return x.join(y, ["node", "g", "k"]).where("rep_a < rep_b and (g = k or hx <> hy)").where(_near(threshold)).select("rep_a", "rep_b", "sx", "sy")


def similar_pairs(sets: DataFrame, threshold: float, **kw) -> DataFrame:
    """``(id_a, id_b, similarity)``, id_a < id_b: the record pairs behind the class pairs, copies of one set included.

    ``sets`` has ``id, members``; members that are null and sets that are null or empty are left out, repeated rows count once. The result is as
    large as the number of similar record pairs; ``classes`` and ``class_pairs`` are the compact form, to be taken where only links are asked for.
    Large classes are paired in blocks, so that a set with many copies is not one task.
    """
    reps, membership = classes(sets)
    membership = materialize(membership)
    pairs = class_pairs(reps, threshold, **kw)
    m = lambda i, r: membership.select(F.col("id").alias(i), F.col("rep").alias(r))
    across = pairs.join(m("_x", "rep_a"), "rep_a").join(m("_y", "rep_b"), "rep_b").select("_x", "_y", "similarity")
    same = _copies(membership).select("_x", "_y", F.lit(1.0).alias("similarity"))
    return across.unionByName(same).select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"), "similarity")


def _copies(membership: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``(_x, _y)``, _x < _y: the pairs of records ``(id, rep)`` of one class, each class in pairs of blocks of about ``together`` records."""
    sizes = membership.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("_k"))
    cut = membership.join(sizes, "rep").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    wide = cut.withColumn("_o", F.explode(F.expr("sequence(0, _k - 1)"))).select("rep", F.least("_b", "_o").alias("g"), F.greatest("_b", "_o").alias("h"), "_b", "id")
    x = wide.select("rep", "g", "h", F.col("_b").alias("_bx"), F.col("id").alias("_x"))
    y = wide.select("rep", "g", "h", F.col("_b").alias("_by"), F.col("id").alias("_y"))
    return x.join(y, ["rep", "g", "h"]).where("_x < _y and (g = h or _bx <> _by)").select("_x", "_y")
