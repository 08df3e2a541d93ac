"""The constraint tables as sets of traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member_set(c: Column) -> Column:
    """The distinct members of a list, sorted: nulls dropped, white space trimmed, lower case, empty ones dropped. A null list is empty."""
    plain = F.transform(c, lambda x: F.lower(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(plain, lambda x: x.isNotNull() & (x != "")))), F.array().cast("array<string>"))


def constraint_sets(pair: DataFrame, position: DataFrame) -> DataFrame:
    """``(id, rule, mined_at, members)``: each constraint id of either table once, sets without members left out."""
    cols = ["constraint_id", "rule", "mined_at", "traces"]
    rows = pair.select(*cols).unionByName(position.select(*cols)).where(F.col("constraint_id").isNotNull())
    sets = rows.select(F.col("constraint_id").alias("id"), "rule", "mined_at", member_set(F.col("traces")).alias("members"))
    once = sets.groupBy("id").agg(F.max(F.struct("rule", "mined_at", "members")).alias("_v")).select("id", "_v.rule", "_v.mined_at", "_v.members")
    return once.where(F.size("members") > 0)
