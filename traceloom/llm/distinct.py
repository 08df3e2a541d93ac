"""Distinct counts from multiresolution bitmaps.

Each identifier falls into one level by the trailing zeros of its hash (level l holds 2^-(l+1) of them) and sets one bit of that
level's bitmap. A sketch is stored as rows ``(group, level, word, bits)`` of 64 bits; sketches are merged by OR, so days, rules or any
other groups combine without the identifiers. An estimate takes the lowest level from which on no bitmap is saturated, counts the levels
above by linear counting and scales by the power of two left out: the relative error does not depend on the scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits per level, levels, and the share of set bits beyond which a level counts as saturated.
BITS, LEVELS, FULL = 4096, 40, 0.75
#: Relative standard error of an estimate with these values (see the tests), and the bound that is used for decisions: four of them.
STANDARD_ERROR = 0.013
ERROR_BOUND = 4 * STANDARD_ERROR


def sketch(rows: DataFrame, group: list[str], value: str, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """``(group…, level, word, bits)`` of the non-null values of ``value``: mergeable, built with map-side combining. Null groups are groups."""
    h = F.xxhash64(F.col(value))
    low = F.expr("bit_count((_h & -_h) - 1)")  # trailing zeros; 64 for a hash of 0
    at = F.pmod(F.xxhash64(F.col(value), F.lit(0x5EED)), F.lit(bits))
    hashed = rows.where(F.col(value).isNotNull()).select(*group, h.alias("_h"), at.alias("_at"))
    placed = hashed.select(*group, F.least(low, F.lit(levels - 1)).cast("int").alias("level"), F.floor(F.col("_at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(_at & 63 as int))").alias("bits"))
    return placed.groupBy(*group, "level", "word").agg(F.bit_or("bits").alias("bits"))


def merge(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of finer groups, or of several runs, as sketches of ``group``."""
    return sketches.groupBy(*group, "level", "word").agg(F.bit_or("bits").alias("bits"))


def estimate(sketches: DataFrame, group: list[str], bits: int = BITS, levels: int = LEVELS, full: float = FULL) -> DataFrame:
    """``(group…, n_distinct)``: the estimated number of different values per group, a double."""
    fill = sketches.groupBy(*group, "level").agg(F.sum(F.bit_count("bits")).alias("_s"))
    keyed = group or ["_all"]
    if not group:
        fill = fill.withColumn("_all", F.lit(1))
    w = Window.partitionBy(*keyed)
    base = F.coalesce(F.max(F.when(F.col("_s") > full * bits, F.col("level") + 1)).over(w), F.lit(0))
    # the last level cannot be passed over; a full bitmap there counts as one bit short of full
    based = fill.withColumn("_base", F.least(base, F.lit(levels - 1)))
    zeros = F.greatest(F.lit(bits) - F.col("_s"), F.lit(1)) / F.lit(float(bits))
    part = -F.lit(float(bits)) * F.log(zeros) * F.pow(F.lit(2.0), F.col("_base"))
    out = based.where(F.col("level") >= F.col("_base")).groupBy(*keyed).agg(F.sum(part).alias("n_distinct"))
    return out.select(*group, "n_distinct")


def low_diversity(rows: DataFrame, group: list[str], value: str, share: float, error: float = ERROR_BOUND) -> DataFrame:
    """``(group…, n_members, n_distinct)``: groups with fewer distinct values than ``share`` of their rows (nulls not counted).

    Decided by the estimate wherever it is farther from the limit than the error bound; only the groups in between are counted exactly, so
    a group's identifiers are shuffled only if its estimate cannot tell. Rows with a null in ``group`` are left out.
    """
    keep = rows.where(F.col(value).isNotNull()).dropna(subset=group)
    totals = keep.groupBy(*group).agg(F.count(F.lit(1)).alias("n_members"))
    est = estimate(sketch(keep, group, value), group).join(totals, group)
    limit = F.lit(share) * F.col("n_members")
    sure = est.where(F.col("n_distinct") < limit * (1 - error))
    unsure = est.where((F.col("n_distinct") >= limit * (1 - error)) & (F.col("n_distinct") < limit * (1 + error))).select(*group, "n_members")
    exact = keep.join(unsure, group).groupBy(*group).agg(F.countDistinct(value).cast("double").alias("n_distinct"), F.first("n_members").alias("n_members"))
    return sure.select(*group, "n_members", "n_distinct").unionByName(exact.where(F.col("n_distinct") < F.lit(share) * F.col("n_members")).select(*group, "n_members", "n_distinct"))
