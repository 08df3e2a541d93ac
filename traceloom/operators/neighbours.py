"""Previous and next row inside a key, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions per chunk. A key with more positions is handled by several tasks; its chunk edges are stitched afterwards.
CHUNK = 65_536


def with_neighbours(df: DataFrame, keys: list[str], order: str, values: list[str], chunk: int = CHUNK, ahead: bool = True) -> DataFrame:
    """``df`` with ``prev_<v>`` (and ``next_<v>``) of the row before (after) within ``keys`` by the integer column ``order``.

    Keys are cut into chunks of ``chunk`` positions. Inside a chunk a window gives the neighbours; the first and last row of each
    chunk (one row per key and chunk) are linked by a second window over chunk edges, and only keys of several chunks take part.
    A key that holds a third of all rows is thus spread over many tasks. ``order`` must be unique within a key and not null.
    """
    parts = [*keys, "_chunk"]
    # one shuffle, which the windows and the chunk edges share
    source = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk))).repartition(*parts)
    rows = source
    w = Window.partitionBy(*parts).orderBy(order)
    for v in values:
        rows = rows.withColumn(f"prev_{v}", F.lag(v).over(w))
        if ahead:
            rows = rows.withColumn(f"next_{v}", F.lead(v).over(w))
    item = F.struct(*values)
    ends = source.groupBy(*parts).agg(F.min_by(item, order).alias("_first"), F.max_by(item, order).alias("_last"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    edges = (
        ends.withColumn("_before", F.lag("_last").over(along))
        .withColumn("_after", F.lead("_first").over(along))
        .where(F.col("_before").isNotNull() | F.col("_after").isNotNull())
        .select(*parts, "_lo", "_hi", "_before", "_after")
    )
    out = rows.join(edges, parts, "left")
    for v in values:
        out = out.withColumn(f"prev_{v}", F.when(F.col(order) == F.col("_lo"), F.col(f"_before.{v}")).otherwise(F.col(f"prev_{v}")))
        if ahead:
            out = out.withColumn(f"next_{v}", F.when(F.col(order) == F.col("_hi"), F.col(f"_after.{v}")).otherwise(F.col(f"next_{v}")))
    return out.drop("_chunk", "_lo", "_hi", "_before", "_after")
