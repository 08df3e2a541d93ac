"""Incremental mining: a batch costs what the traces it touches cost.

State is a list of segments. A batch writes one: the whole traces it touches, as they are now, their facts, and the places of the traces it replaces
(trace and segment). Nothing older is rewritten; a trace's rows in an older segment just no longer count. Beside them stand the counts of the
rules that add up over traces; a batch adds those of its traces as they are and takes off those of the same traces as they were. All supports come from
these counts, complements (absence, co-existence, not-succession …) by arithmetic, so mining does not read the log again. Mining the batches of a
log one after another gives the state, and so every result, of mining the whole log.

A version is a manifest, written under another name and renamed when whole; readers take the highest. A run that stops anywhere leaves the
version before it and files that no manifest names (``vacuum`` removes them). Many segments are merged into one now and then (``COMPACT``).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators import existence, ordered, position, unordered
from traceloom.operators.facts import Facts, build_facts, occurrences
from traceloom.plans.mine import ALL_RULES, Branching, mine, with_support
from traceloom.session import materialize, scratch
from traceloom.sources.logs import LOG_SCHEMA, RunMetadata

#: Segments from which a batch merges them into one.
COMPACT = 32
TYPES_SCHEMA = "trace string, event_type string, c bigint, mn int, mx int, n_next bigint, min_next string, max_next string, n_prev bigint, min_prev string, max_prev string"
COUNTS_SCHEMA = "rule string, event_a string, event_b string, n bigint"
TABLES = {"seq": LOG_SCHEMA, "trace_types": TYPES_SCHEMA, "traces": "trace string"}


def new_events(log: DataFrame, last: str | None, hard: bool = False) -> DataFrame:
    """Events after the last mined time; all of them in a first or hard run. The comparison reaches the scan."""
    return log if hard or not last else log.where(F.col("ts") > F.to_timestamp_ntz(F.lit(last)))


def trace_bounds(events: DataFrame) -> DataFrame:
    """``(trace, min_pos, max_pos)`` over the given events."""
    return events.groupBy("trace").agg(F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"))


def affected_events(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """All events of the traces that have new ones."""
    return log.join(bounds, "trace", "left_semi")


def type_occurrences(log: DataFrame) -> DataFrame:
    """``(event_type, n_events)``."""
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


def replace_traces(old: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Rule rows with those of touched traces taken out and the fresh ones put in."""
    return old.join(touched.select("trace").distinct(), "trace", "left_anti").unionByName(fresh)


def additive_counts(f: Facts, weight) -> DataFrame:
    """``(rule, event_a, event_b, n)``: the rules whose traces add up, each trace with its ``weight``; also ``traces``, their number."""
    none = F.lit(None).cast("string")
    total = F.sum(weight).alias("n")
    parts = [f.st.select("trace").distinct().agg(total).select(F.lit("traces").alias("rule"), none.alias("event_a"), none.alias("event_b"), "n")]
    rows = reduce(DataFrame.unionByName, [position.position_rows(f, r) for r in position.RULES])
    parts.append(rows.groupBy("rule", "event_a").agg(total).select("rule", "event_a", none.alias("event_b"), "n"))
    parts.append(f.st.groupBy("event_type", "c").agg(total).select(F.lit("exactly").alias("rule"), F.col("event_type").alias("event_a"), F.col("c").cast("string").alias("event_b"), "n"))
    parts.append(unordered.both_rows(f).groupBy("event_a", "event_b").agg(total).select(F.lit("responded existence").alias("rule"), "event_a", "event_b", "n"))
    rules = list(ordered.FLAGS)
    wide = ordered.pairs_for(f, rules).groupBy("event_a", "event_b").agg(*[F.sum(F.when(F.expr(ordered.FLAGS[r]), weight)).alias(f"_{i}") for i, r in enumerate(rules)])
    long = wide.select("event_a", "event_b", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_{i}").alias("n")) for i, r in enumerate(rules)])).alias("x"))
    parts.append(long.select("x.rule", "event_a", "event_b", "x.n"))
    return reduce(DataFrame.unionByName, [p.select("rule", "event_a", "event_b", F.col("n").cast("bigint").alias("n")) for p in parts]).where("n <> 0")


def counts_of(counts: DataFrame, rules: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(rule, event_a, event_b, n_traces)`` of any rules from additive counts, and the one row ``n_all``."""
    n_all = counts.where("rule = 'traces'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))
    direct = [r for r in rules if r in position.RULES or r in ordered.FLAGS]
    parts = [counts.where(F.col("rule").isin(direct)).select("rule", "event_a", "event_b", F.col("n").alias("n_traces"))]
    exact = counts.where("rule = 'exactly'").select("event_a", F.col("event_b").cast("bigint").alias("instances"), "n")
    if some := [r for r in rules if r in existence.RULES]:
        parts.append(existence.from_exact(exact, n_all, *some).select("rule", "event_a", F.col("instances").cast("string").alias("event_b"), "n_traces"))
    if some := [r for r in rules if r in unordered.RULES]:
        n = exact.groupBy(F.col("event_a").alias("event_type")).agg(F.sum("n").alias("n"))
        both = counts.where("rule = 'responded existence'").select("event_a", "event_b", F.col("n").alias("n_ab"))
        parts.append(unordered.from_matrix(unordered.from_both(n, both, n_all), *some))
    if "not-succession" in rules:
        held = counts.where("rule = 'response'").crossJoin(F.broadcast(n_all))
        parts.append(held.select(F.lit("not-succession").alias("rule"), "event_a", "event_b", (F.col("n_all") - F.col("n")).alias("n_traces")).where("n_traces > 0"))
    return reduce(DataFrame.unionByName, parts), n_all


class MiningState:
    """The stored events, facts and counts of a log under ``directory``; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.dir = spark, directory.rstrip("/")

    # files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    @property
    def version(self) -> int:
        return max((int(x[:-5]) for x in self._names("manifests") if x.endswith(".json") and x[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What the version (the latest) consists of."""
        version = self.version if version is None else version
        if not version:
            return {"segments": [], "replacing": [], "counts": None, "meta": asdict(RunMetadata())}
        path, fs = self._path(f"manifests/{version:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        """The manifest appears whole, by a rename, or not at all; two writers cannot both make the same version."""
        fresh, fs = self._path(f"manifests/{uuid.uuid4().hex}.part")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._at("written")
        path, _ = self._path(f"manifests/{version:010d}.json")
        if fs.exists(path) or not fs.rename(fresh, path):
            raise RuntimeError(f"version {version} was written by another run")

    def _at(self, step: str) -> None:
        """Called between the steps of an update, for tests."""

    # tables

    def _read(self, name: str, schema: str, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        paths = [f"{self.dir}/{name}/segment={x}" for x in segments]
        return self.spark.read.schema(f"{schema}, segment string").option("basePath", f"{self.dir}/{name}").parquet(*paths)

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The rows that count, with their ``segment``: those of traces that no later segment replaces."""
        m = manifest or self.manifest()
        rows = self._read(name, TABLES[name], m["segments"])
        if not m["replacing"]:
            return rows
        return rows.join(self._read("replaced", "trace string, old string", m["replacing"]).select("trace", F.col("old").alias("segment")), ["trace", "segment"], "left_anti")

    @property
    def log(self) -> DataFrame:
        return self.table("seq").select("trace", "event_type", "ts", "pos")

    @property
    def facts(self) -> Facts:
        return Facts(occurrences(self.log), self.table("trace_types").drop("segment"), True)

    @property
    def counts(self) -> DataFrame:
        return self._counts(self.manifest())

    def _counts(self, m: dict) -> DataFrame:
        return self.spark.read.schema(COUNTS_SCHEMA).parquet(f"{self.dir}/counts/{m['counts']}") if m["counts"] else self.spark.createDataFrame([], COUNTS_SCHEMA)

    @property
    def metadata(self) -> RunMetadata:
        return RunMetadata(**self.manifest()["meta"])

    # runs

    def update(self, batch: DataFrame, hard: bool = False, name: str = "") -> int:
        """Adds a batch ``(trace, event_type, ts, pos)`` and re-mines the traces it touches; returns the new version.

        Which events are new is told by (trace, pos), not by time, so late and equal timestamps are not lost; an event delivered again replaces
        the one before. ``hard`` ignores stored facts and counts and mines every trace afresh, into one segment. An empty batch changes nothing.
        """
        with scratch(self.spark):
            return self._update(batch, hard, name)

    def _update(self, batch: DataFrame, hard: bool, name: str) -> int:
        now = self.version
        m = self.manifest(now)
        rows = batch.select("trace", "event_type", "ts", "pos").where("trace is not null and event_type is not null and pos is not null")
        rows = rows.groupBy("trace", "pos").agg(F.max_by(F.struct("event_type", "ts"), F.col("ts")).alias("_v"), F.max(F.struct("event_type", "ts")).alias("_w"))
        rows = rows.select("trace", F.coalesce("_v", "_w")["event_type"].alias("event_type"), F.coalesce("_v", "_w")["ts"].alias("ts"), "pos")
        incoming = materialize(rows)
        came = incoming.agg(F.count(F.lit(1)).alias("n"), F.max("ts").cast("string").alias("last")).first()
        if not came.n and not hard:
            return now
        segment = uuid.uuid4().hex
        held: list[str] = []
        whole = incoming
        if m["segments"]:
            known = self.table("traces", m)
            owners = materialize(known if hard else known.join(incoming.select("trace").distinct(), "trace", "left_semi"))
            held = sorted(r[0] for r in owners.select("segment").distinct().collect())  # at most COMPACT segments
        if held:
            old = self._read("seq", LOG_SCHEMA, held).join(owners, ["trace", "segment"], "left_semi").select("trace", "event_type", "ts", "pos")
            whole = old.join(incoming.select("trace", "pos"), ["trace", "pos"], "left_anti").unionByName(incoming)
        self._write(whole, "seq", segment)
        fresh = self._read("seq", LOG_SCHEMA, [segment]).select("trace", "event_type", "ts", "pos")
        # both states of the touched traces in one pass, told apart by a sign before their names
        signed = fresh.withColumn("trace", F.concat(F.lit("+"), "trace"))
        if held and not hard:
            signed = signed.unionByName(old.withColumn("trace", F.concat(F.lit("-"), "trace")))
        f = build_facts(signed, keep=True)
        mine_ = f.st.where(F.startswith("trace", F.lit("+"))).withColumn("trace", F.expr("substr(trace, 2)"))
        self._write(mine_, "trace_types", segment)
        self._write(mine_.select("trace").distinct(), "traces", segment)
        weight = F.when(F.startswith("trace", F.lit("+")), F.lit(1)).otherwise(-1).cast("bigint")
        delta = additive_counts(f, weight)
        if not hard:
            delta = self._counts(m).unionByName(delta)
        delta = delta.groupBy("rule", "event_a", "event_b").agg(F.sum("n").alias("n")).where("n <> 0")
        delta.write.parquet(f"{self.dir}/counts/{segment}")  # as many rows as pairs of activities
        self._at("counts")
        replaced = bool(held) and not hard
        if replaced:
            self._write(owners.select("trace", F.col("segment").alias("old")), "replaced", segment)
        meta = RunMetadata(**m["meta"])
        events = (0 if hard else meta.events) + (f.st.agg(F.sum(F.col("c") * weight)).first()[0] or 0)
        latest = max(meta.last_declare_mined, came.last or "")
        traces = self.spark.read.schema(COUNTS_SCHEMA).parquet(f"{self.dir}/counts/{segment}").where("rule = 'traces'").agg(F.sum("n")).first()[0] or 0
        meta = RunMetadata(log_name=name or meta.log_name, traces=traces, events=events, has_previous_stored=True, last_declare_mined=latest)
        fresh_m = {
            "segments": [segment] if hard else [*m["segments"], segment],
            "replacing": [] if hard else [*m["replacing"], *([segment] if replaced else [])],
            "counts": segment,
            "meta": asdict(meta),
        }
        if len(fresh_m["segments"]) > COMPACT:
            fresh_m = self._merged(fresh_m)
        self._at("tables")
        self._commit(now + 1, fresh_m)
        return now + 1

    def _write(self, df: DataFrame, name: str, segment: str) -> None:
        df.write.parquet(f"{self.dir}/{name}/segment={segment}")
        self._at(name)

    def _merged(self, m: dict) -> dict:
        """The same state in one segment."""
        segment = uuid.uuid4().hex
        for name in TABLES:
            self._write(self.table(name, m).drop("segment"), name, segment)
        return {**m, "segments": [segment], "replacing": []}

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests but the latest ``keep``, and what none of these names; not to be run beside an update."""
        versions = sorted(int(x[:-5]) for x in self._names("manifests") if x.endswith(".json"))[-keep:]
        kept = [self.manifest(v) for v in versions]
        named = {x for m in kept for x in [*m["segments"], m["counts"]]}
        files = [f"{t}/{x}" for t in (*TABLES, "replaced", "counts") for x in self._names(t) if x.split("=")[-1] not in named]
        files += [f"manifests/{x}" for x in self._names("manifests") if not (x.endswith(".json") and int(x[:-5]) in versions)]
        for x in files:
            path, fs = self._path(x)
            fs.delete(path, True)

    def mine(self, rules: list[str] | None = None, support: float = 0.0, branching: Branching | None = None) -> DataFrame:
        """``plans.mine.mine`` over the state: from its counts, or, for branching, from its facts."""
        if branching is not None and branching.policy:
            return mine(self.log, rules=rules, support=support, branching=branching, facts=self.facts)
        chosen = list(rules or ALL_RULES)
        if unknown := [r for r in chosen if r not in ALL_RULES]:
            raise ValueError(f"unknown rules {unknown}")
        got, n_all = counts_of(self.counts, chosen)
        return with_support(got, Facts(got, got, memo={"n": n_all}, kept=True), support)


def mine_batches(spark: SparkSession, directory: str, batches: list[DataFrame], **options) -> DataFrame:
    """The result after adding the batches in turn."""
    state = MiningState(spark, directory)
    for b in batches:
        state.update(b)
    return state.mine(**options)


__all__ = ["MiningState", "additive_counts", "affected_events", "build_facts", "counts_of", "mine_batches", "new_events", "replace_traces", "trace_bounds", "type_occurrences"]
