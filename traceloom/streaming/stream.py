"""Streaming: incremental mining of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from traceloom.plans.incremental import MiningState


def mine_stream(events: DataFrame, state_dir: str, checkpoint: str, available_now: bool = True):
    """Starts a query that adds each micro-batch ``(trace, event_type, ts, pos)`` to the state under ``state_dir``.

    A batch that is delivered again after a failure replaces its own events, so the state is the same as after one delivery.
    """
    def add(batch: DataFrame, _: int) -> None:
        MiningState(batch.sparkSession, state_dir).update(batch)

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
