"""Events of a trace against each other, without one task per trace.

Traces are cut into blocks of positions. Inside a block events are joined with each other, so an event meets at most a block. What happened
before a block is carried to it: the last position of each type of the trace, from running maxima over the blocks of a span and over the
spans of a trace. A trace with most of the events is thus spread over its blocks; shorter traces are one block and carry nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.session import materialize

#: Positions per block, blocks per span.
BLOCK, SPAN = 256, 4096


def in_blocks(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(trace, event_type, pos, _block, pp, np)``: with the position of the event of the same type before and after in the block. One shuffle, by block."""
    rows = events.select("trace", "event_type", "pos", F.floor(F.col("pos") / F.lit(block)).alias("_block")).repartition("trace", "_block")
    w = Window.partitionBy("trace", "_block", "event_type").orderBy("pos")
    return rows.withColumn("pp", F.lag("pos").over(w)).withColumn("np", F.lead("pos").over(w))


def carried(rows: DataFrame, span: int = SPAN) -> DataFrame | None:
    """``(trace, _block, event_type, first, seen)`` for each block after another and each type of its trace: the type's first position in the block and its last
    before it. None if no trace has several blocks."""
    per = rows.groupBy("trace", "_block", "event_type").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    several = rows.groupBy("trace").agg(F.min("_block").alias("lo"), F.max("_block").alias("hi")).where("lo < hi").select("trace")
    per = materialize(per.withColumn("_span", F.floor(F.col("_block") / F.lit(span))).join(several, "trace", "left_semi"))
    if per.isEmpty():
        return None
    spans = per.groupBy("trace", "_span", "event_type").agg(F.max("last").alias("last"))
    kinds = spans.select("trace", "event_type").distinct()
    earlier = Window.partitionBy("trace", "event_type").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    grid = spans.select("trace", "_span").distinct().join(kinds, "trace").join(spans, ["trace", "_span", "event_type"], "left")
    ahead = grid.select("trace", "_span", "event_type", F.max("last").over(earlier).alias("_ahead"))
    blocks = per.select("trace", "_span", "_block").distinct()
    within = Window.partitionBy("trace", "_span", "event_type").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    wide = blocks.join(ahead, ["trace", "_span"]).join(per, ["trace", "_span", "_block", "event_type"], "left")
    return wide.select("trace", "_block", "event_type", "first", F.coalesce(F.max("last").over(within), "_ahead").alias("seen"))


def alternations(events: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """``(event_a, event_b, trace, g)`` for A other than B and g > 0: how many As are followed by a B before the next A.

    Such a B is the first after its nearest A: inside a block the two are joined; across blocks it is the first B of a block that has no A
    before it, where A was seen later than B before the block.
    """
    rows = in_blocks(events, block)
    x = rows.select("trace", "_block", F.col("event_type").alias("event_a"), F.col("pos").alias("p"), "np")
    y = rows.select("trace", "_block", F.col("event_type").alias("event_b"), F.col("pos").alias("q"), F.col("pp").alias("pq"))
    inside = x.join(y, ["trace", "_block"]).where("event_a <> event_b and p < q and (np is null or q < np) and (pq is null or pq < p)")
    met = inside.select("event_a", "event_b", "trace")
    before = carried(rows, span)
    if before is not None:
        before = materialize(before)
        a = before.where("seen is not null").select("trace", "_block", F.col("event_type").alias("event_a"), F.col("first").alias("fa"), F.col("seen").alias("sa"))
        b = before.where("first is not null").select("trace", "_block", F.col("event_type").alias("event_b"), F.col("first").alias("fb"), F.col("seen").alias("sb"))
        across = a.join(b, ["trace", "_block"]).where("event_a <> event_b and (sb is null or sa > sb) and (fa is null or fa > fb)")
        met = met.unionByName(across.select("event_a", "event_b", "trace"))
    return met.groupBy("event_a", "event_b", "trace").agg(F.count(F.lit(1)).alias("g"))


def nearest_before(events: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """``(event_a, event_b, trace, pos_a, pos_b)``: for each event b and each type a that came before it in the trace, its nearest place before."""
    rows = in_blocks(events, block)
    x = rows.select("trace", "_block", F.col("event_type").alias("event_a"), F.col("pos").alias("pos_a"), "np")
    y = rows.select("trace", "_block", F.col("event_type").alias("event_b"), F.col("pos").alias("pos_b"))
    cols = ["event_a", "event_b", "trace", "pos_a", "pos_b"]
    out = x.join(y, ["trace", "_block"]).where("pos_a < pos_b and (np is null or pos_b <= np)").select(*cols)
    before = carried(rows, span)
    if before is None:
        return out
    a = before.where("seen is not null").select("trace", "_block", F.col("event_type").alias("event_a"), F.col("seen").alias("pos_a"), "first")
    return out.unionByName(y.join(a, ["trace", "_block"]).where("first is null or first >= pos_b").select(*cols))


def every_pair(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(event_a, event_b, trace, pos_a, pos_b)``: all pairs of events of a trace with pos_a < pos_b, by pairs of blocks.

    As many rows as pairs of events, so a long trace has a great many; no task holds more than two blocks of one for a pair of blocks.
    """
    rows = events.select("trace", "event_type", "pos", F.floor(F.col("pos") / F.lit(block)).alias("_block"))
    blocks = rows.select("trace", "_block").distinct()
    two = blocks.join(blocks.withColumnRenamed("_block", "_other"), "trace").where("_block <= _other")
    x = rows.join(two, ["trace", "_block"]).select("trace", "_block", "_other", F.col("event_type").alias("event_a"), F.col("pos").alias("pos_a"))
    later = rows.withColumnRenamed("_block", "_other").join(two, ["trace", "_other"])
    y = later.select("trace", "_block", "_other", F.col("event_type").alias("event_b"), F.col("pos").alias("pos_b"))
    return x.join(y, ["trace", "_block", "_other"]).where("pos_a < pos_b").select("event_a", "event_b", "trace", "pos_a", "pos_b")
