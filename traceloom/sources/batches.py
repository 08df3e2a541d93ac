"""Seeded batches of growing logs, for tests and benchmarks of incremental mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def make_batches(log: DataFrame, n: int, copied: float = 0.1, continued: float = 0.1, days: int = 30, seed: int = 1) -> list[DataFrame]:
    """``n`` batches made from a log ``(trace, event_type, ts, pos)``.

    Batch k holds every trace under a name of its own, ``days`` later than the batch before. A share ``copied`` of the traces comes twice; a share
    ``continued`` is cut at a position of its own and goes on in the next batch under the same name. Which ones is told by hashes of trace,
    batch and seed, so the batches are the same each time and no trace is brought together.
    """
    lengths = log.groupBy("trace").agg((F.max("pos") + 1).alias("_len"))
    rows = log.join(lengths, "trace")

    def share(k: int, salt: int):
        return F.pmod(F.xxhash64("trace", F.lit(k), F.lit(salt), F.lit(seed)), F.lit(1_000_000)) / 1_000_000

    def named(k: int) -> DataFrame:
        shift = F.make_dt_interval(F.lit(days * k))
        own = rows.withColumn("ts", (F.col("ts") + shift).cast("timestamp_ntz"))
        twice = F.when(share(k, 1) < copied, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        at = F.when((share(k, 2) < continued) & (F.col("_len") > 1), 1 + F.floor(share(k, 3) * (F.col("_len") - 1))).otherwise(F.col("_len"))
        out = own.withColumn("_cut", at).withColumn("_copy", F.explode(twice))
        return out.withColumn("trace", F.concat_ws("_", "trace", F.lit(str(k)), F.col("_copy").cast("string")))

    made = [named(k) for k in range(n)]
    cols = ["trace", "event_type", "ts", "pos"]
    out = []
    for k, b in enumerate(made):
        part = b.where(F.col("pos") < F.col("_cut")).select(*cols)
        if k:
            part = part.unionByName(made[k - 1].where(F.col("pos") >= F.col("_cut")).select(*cols))
        out.append(part)
    return out
