"""Per-key results when a handful of keys hold most rows.

The rows are range-partitioned on (key, secondary order) with Spark's sampled quantiles, so a heavy key is cut into as many
partitions as its share of the rows asks for, and light keys share one. Each partition is sorted and streamed once through Arrow
batches; it gives one partial state per key it holds. A key's states are then stitched: counts add up, and a secondary value that
ends one partition and begins the next is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.session import broadcast_if_bounded, materialize

#: Members per list in ``key_lists``: bounds the size of a row, not of a key.
LIST_SIZE = 10_000


def _parted(df: DataFrame, keys: list[str], order: str, partitions: int | None) -> DataFrame:
    """Only a salt makes equal (key, order) rows divisible: a single pair may itself hold most rows, and is then cut into as many pieces as partitions."""
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    salted = df.select(*keys, order).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"))
    return salted.repartitionByRange(n, *keys, order, "_salt").sortWithinPartitions(*keys, order).drop("_salt")


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; row 0 counts as different. Nulls equal nulls."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    out[0] = True
    for c in columns:
        if pa.types.is_dictionary(c.type):
            c = c.dictionary_decode()
        a, b = c.slice(1), c.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] |= differs | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return out


def key_states(df: DataFrame, keys: list[str], order: str, partitions: int | None = None) -> DataFrame:
    """Partial states ``(keys…, part, n_rows, n_values, first_value, last_value)``: one per key and range partition.

    ``n_values`` counts different non-null values of ``order`` inside the partition; first and last non-null value are kept for stitching.
    """
    key_fields = [df.schema[k] for k in keys]
    value = df.schema[order]
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in key_fields)
    schema = f"{kinds}, part int, n_rows bigint, n_values bigint, first_value {value.dataType.simpleString()}, last_value {value.dataType.simpleString()}"

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        now: list | None = None  # key values, rows, values, first, last
        done: list[list] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(k)) for k in keys]
            vals = b.column(b.schema.get_field_index(order))
            new_key = _starts(cols)
            new_val = _starts([*cols, vals]) & ~pc.is_null(vals).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new_key)
            ends = np.append(at[1:], b.num_rows)
            counts = np.add.reduceat(new_val.astype(np.int64), at)
            for i, (lo, hi) in enumerate(zip(at.tolist(), ends.tolist())):
                key = [c[lo].as_py() for c in cols]
                n = int(counts[i])
                # sorted with nulls first: the non-null values end the stretch
                last = vals[hi - 1].as_py()
                first = None
                if n:
                    first = vals[lo + int(np.argmax(new_val[lo:hi]))].as_py()
                if now is not None and now[0] == key:
                    now[1] += hi - lo
                    now[2] += n - int(n > 0 and now[4] is not None and now[4] == first)
                    now[3] = first if now[3] is None else now[3]
                    now[4] = last if last is not None else now[4]
                else:
                    if now is not None:
                        done.append(now)
                    now = [key, hi - lo, n, first, last]
            if len(done) >= 50_000:
                yield _batch(done, key_fields, part, value)
                done = []
        if now is not None:
            done.append(now)
        if done:
            yield _batch(done, key_fields, part, value)

    return _parted(df, keys, order, partitions).mapInArrow(states, schema)


def _batch(rows: list[list], key_fields: list, part: int, value) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    arrays = [pa.array([r[0][i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(key_fields)]
    kind = to_arrow_type(value.dataType)
    arrays += [pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
    arrays += [pa.array([r[3] for r in rows], kind), pa.array([r[4] for r in rows], kind)]
    return pa.RecordBatch.from_arrays(arrays, [*(f.name for f in key_fields), "part", "n_rows", "n_values", "first_value", "last_value"])


def key_counts(df: DataFrame, keys: list[str], order: str, partitions: int | None = None) -> DataFrame:
    """``(keys…, n_rows, n_values)`` per key: all rows, and different non-null values of ``order``.

    Exact at any skew. Null keys form a group of their own, a null ``order`` counts as a row but not as a value; an empty table gives no rows;
    other columns are ignored. At most one state per key and partition is stitched.
    """
    s = key_states(df, keys, order, partitions)
    w = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    linked = s.withColumn("_prev", F.last("last_value", ignorenulls=True).over(w))
    own = F.col("n_values") - F.when(F.col("first_value") == F.col("_prev"), 1).otherwise(0)
    return linked.select(*keys, "n_rows", own.alias("_own")).groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("_own").alias("n_values"))


def key_lists(df: DataFrame, keys: list[str], order: str, size: int = LIST_SIZE, partitions: int | None = None) -> DataFrame:
    """``(keys…, part, part_no, values)``: the different non-null values of ``order`` per key, in order, in lists of at most ``size``.

    A heavy key's list is cut at partition borders and at ``size`` members, never into one row; (part, part_no) orders the pieces. A value at a
    border that the piece before already has is left out there, so each value occurs once.
    """
    key_fields = [df.schema[k] for k in keys]
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in key_fields)
    kind = df.schema[order].dataType.simpleString()
    schema = f"{kinds}, part int, part_no int, values array<{kind}>"

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        part = TaskContext.get().partitionId()
        arrow = to_arrow_type(df_kind)

        def row(key: list, no: int, values: list) -> pa.RecordBatch:
            arrays = [pa.array([v], to_arrow_type(f.dataType)) for v, f in zip(key, key_fields)]
            arrays += [pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([values], pa.list_(arrow))]
            return pa.RecordBatch.from_arrays(arrays, [*(f.name for f in key_fields), "part", "part_no", "values"])

        key, held, no, last = None, [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(k)) for k in keys]
            vals = b.column(b.schema.get_field_index(order))
            new_key = _starts(cols)
            new_val = _starts([*cols, vals]) & ~pc.is_null(vals).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new_key)
            for lo, hi in zip(at.tolist(), np.append(at[1:], b.num_rows).tolist()):
                k = [c[lo].as_py() for c in cols]
                if k != key:
                    if held:
                        yield row(key, no, held)
                    key, held, no, last = k, [], 0, None
                for v in vals.slice(lo, hi - lo).filter(pa.array(new_val[lo:hi])).to_pylist():
                    if v != last:
                        held.append(v)
                        last = v
                        if len(held) >= size:
                            yield row(key, no, held)
                            held, no = [], no + 1
        if held:
            yield row(key, no, held)

    df_kind = df.schema[order].dataType
    pieces = materialize(_parted(df, keys, order, partitions).mapInArrow(lists, schema))
    # only the ends of each key's partitions are compared, never a key's lists
    ends = pieces.select(*keys, "part", "part_no", F.element_at("values", 1).alias("_f"), F.element_at("values", -1).alias("_l"))
    ends = ends.groupBy(*keys, "part").agg(F.min_by("_f", "part_no").alias("_f"), F.max_by("_l", "part_no").alias("_l"))
    again = ends.withColumn("_p", F.lag("_l").over(Window.partitionBy(*keys).orderBy("part"))).where(F.col("_f") == F.col("_p"))
    marks = again.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("part").alias("_part"))
    marks = broadcast_if_bounded(materialize(marks))  # at most one row per partition: only its first key can go on from the one before
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = reduce(lambda x, y: x & y, [*same, F.col("part") == F.col("_part"), F.col("part_no") == 0])
    cut = F.when(F.col("_part").isNull(), F.col("values")).otherwise(F.expr("slice(values, 2, greatest(size(values) - 1, 0))"))
    return pieces.join(marks, on, "left").select(*keys, "part", "part_no", cut.alias("values")).where(F.size("values") > 0)


def heavy_keys(df: DataFrame, group: list[str], key: str, order: str, share: float, partitions: int | None = None) -> DataFrame:
    """``(group…, key, n_rows, n_values, share)``: keys that hold at least ``share`` of their group's rows with a non-null key."""
    counts = materialize(key_counts(df.where(F.col(key).isNotNull()), [*group, key], order, partitions))
    total = counts.groupBy(*group).agg(F.sum("n_rows").alias("_total"))
    return (
        counts.join(total, group)
        .withColumn("share", F.col("n_rows") / F.col("_total"))
        .where(F.col("n_rows") >= F.lit(share) * F.col("_total"))
        .select(*group, key, "n_rows", "n_values", "share")
    )
