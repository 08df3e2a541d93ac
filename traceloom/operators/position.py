"""Position rules: which activity starts and ends the traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.facts import Facts

RULES = ("first", "last")


def position_rows(f: Facts, rule: str) -> DataFrame:
    """``(rule, event_a, trace)``. ``first``: the event at position 0. ``last``: the event at the greatest position, unless that is 0."""
    if rule == "first":
        got = f.st.where(F.col("mn") == 0).select(F.col("event_type").alias("event_a"), "trace")
    else:
        ends = f.st.groupBy("trace").agg(F.max("mx").alias("end"), F.max_by("event_type", "mx").alias("event_a"))
        got = ends.where(F.col("end") > 0).select("event_a", "trace")
    return got.select(F.lit(rule).alias("rule"), "event_a", "trace")
