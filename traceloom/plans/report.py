"""The text report: one sorted line per rule and operands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.heavy_keys import LIST_SIZE, key_lists


def report_lines(mined: DataFrame) -> DataFrame:
    """``(line)`` of an unbranched or branched result: ``rule|operand[|operand]|n_traces|support`` with three decimals."""
    if "merged" in mined.columns:
        operands = F.when(F.col("side") == "SOURCE", F.concat_ws("|", "merged", "fixed")).otherwise(F.concat_ws("|", "fixed", "merged"))
    else:
        operands = F.concat_ws("|", "event_a", "event_b")
    return mined.select(F.concat_ws("|", "rule", operands, F.col("n_traces").cast("string"), F.format_string("%.3f", "support")).alias("line"))


def trace_lines(rows: DataFrame, n_all: int, size: int = LIST_SIZE) -> DataFrame:
    """``(line)`` with the trace ids in it: ``rule|operands|t1,t2,…|support``, from rule rows ``(rule, event_a, event_b, trace)``.

    Rows are range-partitioned by rule, operands and trace; a rule that holds in more than ``size`` traces goes on in further lines of the same operands and
    support, so no line holds an unbounded list.
    """
    keys = ["rule", "event_a", "event_b"]
    pieces = key_lists(rows, keys, "trace", size)
    total = pieces.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum(F.size("values")).alias("_n"))
    both = pieces.join(total, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select(*keys, "_n", "part", "part_no", "values")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "part_no", "values"))), lambda x: x["values"])
    short = both.where(F.col("_n") <= size).groupBy(*keys, "_n").agg(F.flatten(listed).alias("values"))  # cut by the borders of partitions only
    every = short.unionByName(both.where(F.col("_n") > size).drop("part", "part_no"))
    return every.select(F.concat_ws("|", *keys, F.array_join("values", ","), F.format_string("%.3f", F.col("_n") / F.lit(n_all))).alias("line"))


def report_name(log: str, support: float, bound: int, policy: str | None) -> str:
    return f"constraints_{log}_s{support}_b{bound}_p{policy or 'none'}.txt"


def write_report(lines: DataFrame, path: str) -> None:
    """Sorted text under ``path``; the sort is a range partition, the files are in order."""
    lines.orderBy("line").write.mode("overwrite").text(path)


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(side, line)``: lines of one report that the other lacks, repeated ones as often as they lack."""
    one = first.select("line").exceptAll(second.select("line")).select(F.lit("first").alias("side"), "line")
    two = second.select("line").exceptAll(first.select("line")).select(F.lit("second").alias("side"), "line")
    return one.unionByName(two)
