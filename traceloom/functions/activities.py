"""Catalogue spelling of freely written activity names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.session import broadcast_if_bounded, collect_bounded, materialize

#: The catalogue is a small reference table; it is compared with every unknown spelling, so its size is checked.
CATALOGUE_ROWS = 5_000


def letters(c: Column) -> Column:
    """The letters of a text in lower case, everything else removed."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]", "")


def spelling_map(written: DataFrame, catalogue: DataFrame, column: str = "event_type") -> DataFrame:
    """``(written, activity)``: each distinct non-null spelling and the catalogue entry nearest to it.

    ``written`` has one string column ``written`` (any number of rows), ``catalogue`` a string column ``column``.
    Nearest: the fewest letters different, missing or added, case and everything but letters disregarded; of equally
    near entries the first in alphabetical order. Exact matches never enter the distance search. With an empty
    catalogue every activity is null. Extra columns are ignored. The result is materialised.
    """
    spark = written.sparkSession
    names = catalogue.where(F.col(column).isNotNull()).select(F.col(column).alias("activity")).distinct()
    entries = sorted(r[0] for r in collect_bounded(names, CATALOGUE_ROWS, "catalogue entries"))
    distinct = written.where(F.col("written").isNotNull()).select("written").distinct().withColumn("_k", letters(F.col("written")))
    if not entries:
        return materialize(distinct.select("written", F.lit(None).cast("string").alias("activity")))
    known = (
        spark.createDataFrame([(x,) for x in entries], "activity string")
        .withColumn("_k", letters(F.col("activity")))
        .groupBy("_k")
        .agg(F.min("activity").alias("activity"))
    )
    table = F.array(*[F.struct(F.lit(_plain(x)).alias("k"), F.lit(x).alias("a")) for x in entries])
    nearest = F.array_min(F.transform(table, lambda e: F.struct(F.levenshtein(F.col("_k"), e["k"]).alias("d"), e["a"].alias("a"))))["a"]
    found = distinct.join(F.broadcast(known), "_k", "left")
    exact = found.where(F.col("activity").isNotNull()).select("written", "activity")
    rest = found.where(F.col("activity").isNull()).select("_k", "written").repartition(F.col("_k")).select("written", nearest.alias("activity"))
    return materialize(exact.unionByName(rest))


def _plain(x: str) -> str:
    return "".join(c for c in x.lower() if c.isalpha())


def with_activity(df: DataFrame, mapping: DataFrame, column: str = "event_type", out: str = "activity") -> DataFrame:
    """``df`` with the catalogue spelling of ``column`` in ``out`` (null where the spelling is null).

    The mapping has one row per distinct spelling; it is broadcast only if it is small enough, which is counted.
    """
    m = broadcast_if_bounded(mapping.select(F.col("written").alias("_written"), F.col("activity").alias(out)))
    return df.join(m, df[column] == F.col("_written"), "left").drop("_written")
