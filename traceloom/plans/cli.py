"""Command line: ``python -m traceloom.plans.cli -l LOG [options]``."""

from __future__ import annotations

import argparse
from dataclasses import dataclass


@dataclass(frozen=True)
class RunConfig:
    log: str
    support: float = 0.0
    policy: str | None = None
    side: str = "TARGET"
    bound: int = 0
    drop_factor: float = 1.5
    drop_rare: bool = False
    exact_bound: bool = False
    hard: bool = False
    format: str = "sequence"
    out: str = "."
    lists: bool = False


def parse(args: list[str]) -> RunConfig:
    """Bad arguments raise ``ValueError``."""

    class Parser(argparse.ArgumentParser):
        def error(self, message: str):
            raise ValueError(message)

    p = Parser(prog="traceloom", add_help=False)
    p.add_argument("-l", "--log", required=True, help="path of the log")
    p.add_argument("-s", "--support", type=float, default=0.0)
    p.add_argument("-p", "--policy", type=str.upper, choices=["AND", "OR", "XOR"])
    p.add_argument("-t", "--side", type=str.upper, choices=["SOURCE", "TARGET"], default="TARGET")
    p.add_argument("-b", "--bound", type=int, default=0)
    p.add_argument("-d", "--drop-factor", type=float, default=1.5)
    p.add_argument("-r", "--drop-rare", action="store_true")
    p.add_argument("-u", "--exact-bound", action="store_true")
    p.add_argument("-h", "--hard", action="store_true", help="mine every trace afresh")
    p.add_argument("-f", "--format", choices=["sequence", "xes", "text"], default="sequence")
    p.add_argument("-o", "--out", default=".")
    p.add_argument("-i", "--lists", action="store_true", help="trace ids in the report instead of their number; not with branching")
    got = vars(p.parse_args(args))
    if got["support"] < 0 or got["support"] > 1 or got["bound"] < 0:
        raise ValueError("support is a share, bound not negative")
    if got["lists"] and got["policy"]:
        raise ValueError("branched reports have no trace ids")
    if got["bound"] == 0:
        got["exact_bound"] = False
    return RunConfig(**got)


def run(spark, c: RunConfig):
    """Mines the log of a configuration through its stored state and writes the report; returns the report's path."""
    from functools import reduce
    from pathlib import PurePosixPath

    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from traceloom.plans.incremental import MiningState
    from traceloom.plans.mine import ALL_RULES, Branching, rule_rows
    from traceloom.plans.report import report_lines, report_name, trace_lines, write_report
    from traceloom.session import scratch
    from traceloom.sources import logs

    read = {"sequence": logs.read_sequence, "xes": logs.read_xes, "text": logs.read_with_timestamp}[c.format]
    name = PurePosixPath(c.log).name.split(".")[0]
    state = MiningState(spark, f"{c.out}/state/{name}")
    state.update(read(spark, c.log), hard=c.hard, name=name)
    branching = Branching(c.policy, c.side, c.bound, c.drop_factor, c.drop_rare, c.exact_bound) if c.policy else None
    path = f"{c.out}/{report_name(name, c.support, c.bound, c.policy)}"
    with scratch(spark):
        mined = state.mine(support=c.support, branching=branching)
        if c.lists:
            f = state.facts
            kept = mined.select("rule", "event_a", F.coalesce("event_b", F.lit("")).alias("_b"))
            rows = reduce(DataFrame.unionByName, [rule_rows(f, r) for r in ALL_RULES]).withColumn("_b", F.coalesce("event_b", F.lit("")))
            lines = trace_lines(rows.join(kept, ["rule", "event_a", "_b"], "left_semi").select("rule", "event_a", "event_b", "trace"), state.metadata.traces)
        else:
            lines = report_lines(mined)
        write_report(lines, path)
    return path


def main(args: list[str] | None = None) -> None:
    import sys

    from traceloom.session import session_from

    config = parse(sys.argv[1:] if args is None else args)
    print(run(session_from(), config))


if __name__ == "__main__":
    main()
