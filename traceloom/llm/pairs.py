"""Items that appear together: pair counts over baskets and how far they exceed chance.

Large baskets are cut into blocks of items by hash; every pair of blocks is a group of its own, so the products of one huge basket are
spread over tasks and no group holds more than about two blocks. Ordinary baskets are the case of one block. All groups go through the
same equi self-join and one count with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.activities import spelling_map, with_activity
from traceloom.session import broadcast_if_bounded, materialize

#: Expected items per block of a large basket.
BLOCK = 256


def cooccurrences(baskets: DataFrame, min_count: int = 1, min_share: float = 0.0, block: int = BLOCK) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n_all, lift, pmi, jaccard)`` for item_a < item_b that share enough baskets.

    ``baskets`` has ``basket, item``; repeated rows count once, rows with a null basket are left out, a null item makes its basket count
    in ``n_all`` without an item. Kept are pairs with ``n_ab >= min_count`` and ``n_ab >= min_share * n_all``; items rarer than that cannot be
    in such a pair and are left out before any product. lift = n_ab * n_all / (n_a * n_b). No baskets: no rows.
    """
    rows = materialize(baskets.where(F.col("basket").isNotNull()).select("basket", "item").distinct())
    total = rows.agg(F.countDistinct("basket").alias("n_all"))
    n_all = total.first()[0]
    least = max(min_count, min_share * n_all)
    counts = rows.where(F.col("item").isNotNull()).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    items = materialize(counts.where(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()))
    known = broadcast_if_bounded(items)
    held = rows.join(known, "item").select("basket", "id")
    large = held.groupBy("basket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    large = materialize(large.select("basket", F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_k")))
    cut = held.join(broadcast_if_bounded(large), "basket", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    own = cut.withColumn("h", F.when(F.col("_k") == 1, 0).otherwise(F.pmod(F.xxhash64("id"), F.col("_k"))).cast("int"))
    spread = own.withColumn("_o", F.explode(F.when(F.col("_k") == 1, F.array(F.lit(0))).otherwise(F.expr("sequence(0, _k - 1)"))))
    side = spread.select("basket", F.least("h", "_o").alias("g"), F.greatest("h", "_o").alias("k"), "h", "id")
    x = side.select("basket", "g", "k", F.col("h").alias("hx"), F.col("id").alias("a"))
    y = side.select("basket", "g", "k", F.col("h").alias("hy"), F.col("id").alias("b"))
    pairs = x.join(y, ["basket", "g", "k"]).where("a < b and (g = k or hx <> hy)").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    kept = pairs.where(F.col("n_ab") >= least)
    first = known.select(F.col("id").alias("a"), F.col("item").alias("_ia"), F.col("n").alias("_na"))
    second = known.select(F.col("id").alias("b"), F.col("item").alias("_ib"), F.col("n").alias("_nb"))
    named = kept.join(first, "a").join(second, "b")
    swap = F.col("_ia") > F.col("_ib")
    out = named.select(
        F.when(swap, F.col("_ib")).otherwise(F.col("_ia")).alias("item_a"), F.when(swap, F.col("_ia")).otherwise(F.col("_ib")).alias("item_b"),
        "n_ab", F.when(swap, F.col("_nb")).otherwise(F.col("_na")).alias("n_a"), F.when(swap, F.col("_na")).otherwise(F.col("_nb")).alias("n_b"),
        F.lit(n_all).cast("bigint").alias("n_all"),
    )
    lift = F.col("n_ab") * F.col("n_all") / (F.col("n_a") * F.col("n_b"))
    return out.withColumn("lift", lift).withColumn("pmi", F.log(lift)).withColumn("jaccard", F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab")))


def activity_baskets(pair_row: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(basket, item)``: the activities on either side of a trace's rows, in catalogue spelling; a null side gives a null item."""
    sides = pair_row.where(F.col("trace").isNotNull()).select(F.col("trace").alias("basket"), F.explode(F.array("event_a", "event_b")).alias("_w"))
    mapping = spelling_map(sides.select(F.col("_w").alias("written")), catalogue)
    return with_activity(sides.distinct(), mapping, "_w", "item").select("basket", "item")


def associated(pairs: DataFrame, lift: int) -> DataFrame:
    """Pairs with n_ab * n_all >= lift * n_a * n_b, in whole numbers."""
    return pairs.where(F.col("n_ab").cast("decimal(38,0)") * F.col("n_all") >= F.lit(lift).cast("decimal(38,0)") * F.col("n_a") * F.col("n_b"))
