"""The cleaned form of a raw event log: late, repeated and corrected rows resolved, names unified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.activities import spelling_map, with_activity


def event_time(c: Column) -> Column:
    """A written local date and time as ``timestamp_ntz``; ``T`` or a blank between, fractions optional; null if unreadable."""
    return F.regexp_replace(F.trim(c), "T", " ").try_cast("timestamp_ntz")


def latest_rows(events: DataFrame, chunk: int | None = None) -> DataFrame:
    """Rows with a trace, a type and a position; of several with the same (trace, pos) the one that arrived last.

    One aggregation, so a huge trace is spread over all tasks. A null ``arrived_at`` counts as earliest; rows that
    arrived at the same time are told apart by their content, so that the result does not depend on the order of rows.
    With ``chunk`` the rows are laid out by (trace, ``_chunk`` of that many positions), for windows that follow, in the same shuffle.
    """
    kept = events.where(F.col("trace").isNotNull() & F.col("event_type").isNotNull() & F.col("pos").isNotNull())
    last = F.max(F.struct("arrived_at", "event_type", "ts")).alias("_v")
    keys = ["trace", "pos"]
    if chunk:
        kept = kept.select("trace", F.floor(F.col("pos") / F.lit(chunk)).cast("int").alias("_chunk"), "pos", "event_type", "ts", "arrived_at").repartition("trace", "_chunk")
        keys = ["trace", "_chunk", "pos"]
    return kept.groupBy(*keys).agg(last).select(*keys, F.col("_v.event_type").alias("event_type"), F.col("_v.ts").alias("ts"))


def cleaned_log(events: DataFrame, catalogue: DataFrame, chunk: int | None = None) -> DataFrame:
    """``(trace, event_type, ts, pos)`` of a raw log with catalogue spellings; ``ts`` is a timestamp_ntz. With ``chunk`` also ``_chunk``.

    Needs the columns ``trace, event_type, ts, pos, arrived_at``; others are ignored.
    """
    mapping = spelling_map(events.select(F.col("event_type").alias("written")), catalogue)
    rows = with_activity(latest_rows(events, chunk), mapping)
    return rows.select("trace", F.col("activity").alias("event_type"), event_time(F.col("ts")).alias("ts"), "pos", *(["_chunk"] if chunk else []))
