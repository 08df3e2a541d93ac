"""Runs of the same event logged again and again, collapsed into one row each.

Only boundary rows are kept: events that differ from the one before, and the last event of a chunk. ``lead`` over them gives
each run's end: differences of row numbers are counts, the time of the row before the next start ends the duration. Traces are cut
into chunks of positions, so that one trace with a third of all events is worked on by many tasks; a run that crosses chunk borders is
stitched from the first and last runs of the chunks, two rows per chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.sources.cleaned import cleaned_log

CHUNK = 16_384


def collapse_runs(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(trace, event_type, first_pos, last_pos, n_events, first_ts, last_ts, duration_s)``: every run, single events included.

    ``log`` has ``trace, event_type, ts, pos`` with (trace, pos) unique; gaps between positions do not end a run. Rows with a null trace, type
    or position are left out; a null ``ts`` gives a null duration only where it is a run's first or last event; time that runs
    backwards gives a negative duration, as logged. An empty log gives no rows; other columns are ignored. ``_chunk``, if the log has
    it, is its layout by chunks of ``chunk`` positions.
    """
    if "_chunk" in log.columns:
        rows = log.select("trace", "_chunk", "pos", "event_type", "ts")
    else:
        rows = log.select("trace", F.floor(F.col("pos") / F.lit(chunk)).cast("int").alias("_chunk"), "pos", "event_type", "ts")
    rows = rows.where(F.col("trace").isNotNull() & F.col("pos").isNotNull() & F.col("event_type").isNotNull())
    w = Window.partitionBy("trace", "_chunk").orderBy("pos")
    seen = (
        rows.withColumn("_n", F.row_number().over(w))
        .withColumn("_pt", F.lag("event_type").over(w))
        .withColumn("_pp", F.lag("pos").over(w))
        .withColumn("_pts", F.lag("ts").over(w))
        .withColumn("_end", F.lead("pos").over(w).isNull())
        .withColumn("_start", F.col("_pt").isNull() | (F.col("_pt") != F.col("event_type")))
    )
    marks = seen.where("_start or _end")
    after = marks.select(
        "trace", "_chunk", "event_type", "pos", "ts", "_n", "_start", "_end",
        F.lead(F.struct("_start", "pos", "ts", "_n", "_pp", "_pts")).over(w).alias("_x"),
    ).where("_start")
    ends_here = F.col("_x").isNull()
    ends_before = F.col("_x._start")
    run = after.select(
        "trace", "_chunk", "event_type", F.col("pos").alias("first_pos"), F.col("ts").alias("first_ts"),
        F.when(ends_here, F.col("pos")).when(ends_before, F.col("_x._pp")).otherwise(F.col("_x.pos")).alias("last_pos"),
        F.when(ends_here, F.col("ts")).when(ends_before, F.col("_x._pts")).otherwise(F.col("_x.ts")).alias("last_ts"),
        F.when(ends_here, F.lit(1)).when(ends_before, F.col("_x._n") - F.col("_n")).otherwise(F.col("_x._n") - F.col("_n") + 1).cast("bigint").alias("n_events"),
        (F.col("_n") == 1).alias("_head"), (ends_here | ~ends_before).alias("_tail"),
    )
    inner = run.where("not _head and not _tail").select("trace", "event_type", "first_pos", "last_pos", "n_events", "first_ts", "last_ts")
    along = Window.partitionBy("trace").orderBy("_chunk", "first_pos")
    edge = run.where("_head or _tail")
    joined = F.col("_head") & F.coalesce(F.lag("_tail").over(along), F.lit(False)) & (F.lag("event_type").over(along) == F.col("event_type"))
    grouped = edge.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(along))
    stitched = grouped.groupBy("trace", "_run").agg(
        F.min_by("event_type", "first_pos").alias("event_type"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.sum("n_events").alias("n_events"),
        F.min_by("first_ts", "first_pos").alias("first_ts"), F.max_by("last_ts", "first_pos").alias("last_ts"),
    )
    out = inner.unionByName(stitched.drop("_run"))
    seconds = F.expr("timestampdiff(MICROSECOND, first_ts, last_ts) / 1e6")
    return out.withColumn("duration_s", seconds).select("trace", "event_type", "first_pos", "last_pos", "n_events", "first_ts", "last_ts", "duration_s")


def cleaned_runs(events: DataFrame, catalogue: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The runs of a raw event log after cleaning; the cleaning's only shuffle also lays the rows out for the windows."""
    return collapse_runs(cleaned_log(events, catalogue, chunk), chunk)
