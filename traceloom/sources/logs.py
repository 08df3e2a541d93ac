"""Event logs: case notions over tables, the indexed log layout, XES and text logs."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.operators.blocks import every_pair, nearest_before

LOG_SCHEMA = "trace string, event_type string, ts timestamp_ntz, pos int"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def event_log(df: DataFrame, trace: Column, activity: Column, order_by: list, ts: Column | None = None, chunk: Column | None = None) -> DataFrame:
    """A table as an event log: ``(trace, event_type, ts, pos)``; ``pos`` counts from 0 within a trace in the order given.

    The order must be total within a trace. Rows without trace or activity are left out. ``chunk``: a coarse value that never falls along the order
    (the day of a time, say); rows are then numbered inside (trace, chunk), and the sizes of earlier chunks are added, so that a
    trace with most of the rows is numbered by many tasks.
    """
    order = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)]
    time = (ts if ts is not None else F.lit(None)).cast("timestamp_ntz").alias("ts")
    rows = df.select(trace.cast("string").alias("trace"), activity.cast("string").alias("event_type"), time, (F.lit(0) if chunk is None else chunk).alias("_chunk"), *order)
    kept = rows.where(F.col("trace").isNotNull() & F.col("event_type").isNotNull())
    along = [f"_o{i}" for i in range(len(order_by))]
    if chunk is None:
        w = Window.partitionBy("trace").orderBy(*along)
        return kept.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).select("trace", "event_type", "ts", "pos")
    parts = ["trace", "_chunk"]
    kept = kept.repartition(*parts)
    w = Window.partitionBy(*parts).orderBy(*along)
    before = Window.partitionBy("trace").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ahead = sizes.select(F.col("trace").alias("_t"), F.col("_chunk").alias("_c"), "_before")
    numbered = kept.withColumn("_rn", F.row_number().over(w)).join(ahead, (F.col("trace") == F.col("_t")) & F.col("_chunk").eqNullSafe(F.col("_c")))
    return numbered.select("trace", "event_type", "ts", (F.col("_before") + F.col("_rn") - 1).cast("int").alias("pos"))


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """The indexed event sequence: parquet with ``trace_id, timestamp, event_type, position``, bound by name."""
    t = spark.read.parquet(path)
    return t.select(F.col("trace_id").alias("trace"), "event_type", F.col("timestamp").try_cast("timestamp_ntz").alias("ts"), F.col("position").cast("int").alias("pos"))


def read_single_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored activity index ``(event_type, trace)``."""
    return spark.read.parquet(path).select("event_type", F.col("trace_id").alias("trace"))


def read_pair_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored pair index ``(event_a, event_b, trace, pos_a, pos_b)``."""
    t = spark.read.parquet(path)
    return t.select(F.col("eventA").alias("event_a"), F.col("eventB").alias("event_b"), F.col("trace_id").alias("trace"), F.col("positionA").alias("pos_a"), F.col("positionB").alias("pos_b"))


def single_index(log: DataFrame) -> DataFrame:
    """``(event_type, trace)``: which activities occur in which traces."""
    return log.select("event_type", "trace").distinct()


def pair_index(log: DataFrame) -> DataFrame:
    """``(event_a, event_b, trace, pos_a, pos_b)``: for each event b and each activity a before it, the nearest such a.

    One row per event and activity before it, not one per pair of events.
    """
    return nearest_before(log)


def full_pair_index(log: DataFrame) -> DataFrame:
    """``(event_a, event_b, trace, pos_a, pos_b)`` of every two events of a trace with pos_a < pos_b; as large as the pairs of events."""
    return every_pair(log)


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """An XES log. Positions follow document order, as timestamps may be equal."""
    attr = "array<struct<_key: string, _value: string>>"
    event = f"array<struct<string: {attr}, date: {attr}, int: {attr}>>"
    raw = spark.read.format("xml").option("rowTag", "trace").schema(f"string {attr}, event {event}").load(path)
    named = lambda c, key: F.expr(f"filter({c}, x -> x._key = '{key}')[0]._value")
    rows = raw.select(named("string", "concept:name").alias("trace"), F.posexplode("event").alias("pos", "e"))
    time = F.to_timestamp(named("e.date", "time:timestamp"))
    return rows.select("trace", named("e.string", "concept:name").alias("event_type"), F.to_timestamp_ntz(F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), F.col("pos").cast("int").alias("pos"))


def write_xes(log: DataFrame, path: str) -> None:
    """A log as ``read_xes`` reads it. A trace is one element, so this is for logs of ordinary traces."""
    attr = lambda key, value: F.array(F.struct(F.lit(key).alias("_key"), value.alias("_value")))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    event = F.struct(attr("concept:name", F.col("event_type")).alias("string"), F.when(F.col("ts").isNotNull(), attr("time:timestamp", time)).alias("date"))
    traces = log.groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("pos", event.alias("e")))).alias("s"))
    rows = traces.select(attr("concept:name", F.col("trace")).alias("string"), F.col("s.e").alias("event"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)


def write_sequence(log: DataFrame, path: str) -> None:
    """A log as ``read_sequence`` reads it."""
    log.select(F.col("trace").alias("trace_id"), F.col("ts").cast("string").alias("timestamp"), "event_type", F.col("pos").alias("position")).write.mode("overwrite").parquet(path)


def read_with_timestamp(spark: SparkSession, path: str) -> DataFrame:
    """Text logs, one trace a line: ``trace::event/delab/yyyy-MM-dd HH:mm:ss,event/delab/…``."""
    lines = spark.read.text(path).where(F.col("value").contains("::"))
    head = F.split("value", "::", 2)
    rows = lines.select(head[0].alias("trace"), F.posexplode(F.split(head[1], ",")).alias("pos", "e"))
    part = F.split("e", "/delab/", 2)
    return rows.where(F.trim("e") != "").select("trace", part[0].alias("event_type"), F.get(part, F.lit(1)).try_cast("timestamp_ntz").alias("ts"), F.col("pos").cast("int").alias("pos"))


def write_with_timestamp(log: DataFrame, path: str) -> None:
    """A log as ``read_with_timestamp`` reads it. A trace is a line, so this is for logs of ordinary traces."""
    event = F.concat(F.col("event_type"), F.lit("/delab/"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    lines = log.groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("pos", event.alias("e")))).alias("s"))
    lines.select(F.concat(F.col("trace"), F.lit("::"), F.array_join(F.col("s.e"), ",")).alias("value")).write.mode("overwrite").text(path)


@dataclass
class RunMetadata:
    """What is remembered of a log between runs."""

    log_name: str = ""
    traces: int = 0
    events: int = 0
    pairs: int = 0
    lookback: int = 0
    has_previous_stored: bool = False
    filename: str = ""
    mode: str = ""
    compression: str = ""
    last_declare_mined: str = ""


META_SCHEMA = "log_name string, traces bigint, events bigint, pairs bigint, lookback int, has_previous_stored boolean, filename string, mode string, compression string, last_declare_mined string"


def read_metadata(spark: SparkSession, path: str) -> RunMetadata:
    """The stored metadata; the defaults where the table or a column is missing."""
    if not _exists(spark, path):
        return RunMetadata()
    row = spark.read.parquet(path).limit(1).collect()
    got = row[0].asDict() if row else {}
    return RunMetadata(**{k: got[k] for k in asdict(RunMetadata()) if got.get(k) is not None})


def write_metadata(spark: SparkSession, meta: RunMetadata, path: str) -> None:
    spark.createDataFrame([asdict(meta)], META_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


# case notions over the driver's tables


def events_user_day(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    day = F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
    return event_log(e, day, F.col("event_type"), ["ts", "event_id"], F.col("ts"))


def events_user(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    return event_log(e, F.col("user_id"), F.col("event_type"), ["ts", "event_id"], F.col("ts"), chunk=F.col("ts").cast("date"))


def orders_customer(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return event_log(o, F.col("o_custkey"), F.col("o_orderpriority"), ["o_orderdate", "o_orderkey"], F.col("o_orderdate"), chunk=F.year("o_orderdate"))
