"""The two fact tables every rule family is computed from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.neighbours import with_neighbours
from traceloom.session import materialize


def events_of(log: DataFrame) -> DataFrame:
    """``(trace, event_type, pos)`` of a log; events with a null among them are left out."""
    return log.select("trace", "event_type", "pos").where(F.col("trace").isNotNull() & F.col("event_type").isNotNull() & F.col("pos").isNotNull())


def occurrences(log: DataFrame) -> DataFrame:
    """Each event with the types before and after it (``prev_event_type``, ``next_event_type``) in its trace.

    ``log`` has ``trace, event_type, pos`` with ``pos`` unique within a trace; events with a null among them are left out.
    """
    return with_neighbours(events_of(log), ["trace"], "pos", ["event_type"])


def trace_types(occ: DataFrame) -> DataFrame:
    """One row per (trace, type): count, first and last position; of events with neighbours also whether one type always follows or precedes it."""
    own = [F.count(F.lit(1)).alias("c"), F.min("pos").alias("mn"), F.max("pos").alias("mx")]
    if "next_event_type" in occ.columns:
        for side in ("next", "prev"):
            other = F.col(f"{side}_event_type")
            own += [F.count(other).alias(f"n_{side}"), F.min(other).alias(f"min_{side}"), F.max(other).alias(f"max_{side}")]
    return occ.groupBy("trace", "event_type").agg(*own)


@dataclass
class Facts:
    """``occ``: events, with neighbours if any rule asks for them; ``st``: per trace and type; ``traces``: the trace universe; ``types``: the activities.

    ``kept``: the tables are stored; what several rules derive from them is stored too (in ``memo``).
    """

    occ: DataFrame
    st: DataFrame
    kept: bool = False
    memo: dict = field(default_factory=dict)

    def once(self, name: str, make) -> DataFrame:
        """A derived table: made anew for a single rule, stored on first use where the facts are kept."""
        if not self.kept:
            return make()
        if name not in self.memo:
            self.memo[name] = materialize(make())
        return self.memo[name]

    @property
    def traces(self) -> DataFrame:
        return self.st.select("trace").distinct()

    @property
    def types(self) -> DataFrame:
        return self.st.select("event_type").distinct()

    @property
    def n(self) -> DataFrame:
        """One row: the number of traces."""
        return self.once("n", lambda: self.st.agg(F.countDistinct("trace").alias("n_all")))


def build_facts(log: DataFrame, keep: bool = False, neighbours: bool = True) -> Facts:
    """The facts of a log. ``keep`` stores both tables, for several rules to be computed from them; only chain rules need ``neighbours``."""
    occ = occurrences(log) if neighbours else events_of(log)
    if not keep:
        return Facts(occ, trace_types(occ))
    occ = materialize(occ)
    return Facts(occ, materialize(trace_types(occ)), True)
