"""The queries of the core operators over the driver's tables, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.activities import spelling_map, with_activity
from traceloom.operators import existence, ordered, position, unordered
from traceloom.operators.facts import build_facts
from traceloom.operators.heavy_keys import heavy_keys, key_counts, key_lists
from traceloom.plans import incremental
from traceloom.plans.mine import Branching, mine, rule_counts, rule_rows, with_support
from traceloom.plans.report import report_lines, trace_lines
from traceloom.sources import cleaned, logs

CUT = "2024-01-20 12:00:00"
Query = Callable[[SparkSession, str], DataFrame]


def _support(rule: str) -> Query:
    def q(spark: SparkSession, d: str) -> DataFrame:
        f = build_facts(logs.events_user_day(spark, d), neighbours="chain" in rule)
        if rule in position.RULES:
            return with_support(rule_counts(f, rule), f).select("rule", "event_a", "n_traces", "support")
        if rule in existence.RULES:
            return with_support(existence.existence_counts(f, rule), f).select("rule", "event_a", "instances", "n_traces", "support")
        return with_support(rule_counts(f, rule), f).select("rule", "event_a", "event_b", "n_traces", "support")

    return q


def _branched(policy: str, side: str = "TARGET", bound: int = 2, rule: str = "response", **kw) -> Query:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return mine(logs.events_user_day(spark, d), [rule], branching=Branching(policy, side, bound, **kw))

    return q


def _incremental(rules: tuple) -> Query:
    """The log cut in two batches, mined one after the other from stored state."""

    def q(spark: SparkSession, d: str) -> DataFrame:
        from traceloom.session import scratch_dir

        log = logs.events_user_day(spark, d)
        cut = F.to_timestamp_ntz(F.lit(CUT))
        folder = f"{scratch_dir(spark)}/state-{uuid.uuid4().hex}"
        return incremental.mine_batches(spark, folder, [log.where(F.col("ts") <= cut), log.where(F.col("ts") > cut)], rules=list(rules))

    return q


def _written(spark: SparkSession, d: str) -> DataFrame:
    """``(field, written, trace)``: the activity columns of both rule row tables, nulls left out."""
    p = spark.read.parquet(f"{d}/position_row.parquet")
    r = spark.read.parquet(f"{d}/pair_row.parquet").select("event_a", "event_b", "trace")
    one = lambda t, c, name: t.select(F.lit(name).alias("field"), F.col(c).alias("written"), "trace").where(F.col("written").isNotNull())
    sides = r.select(F.explode(F.array(F.struct(F.lit("pair_row.event_a").alias("field"), F.col("event_a").alias("written")), F.struct(F.lit("pair_row.event_b").alias("field"), F.col("event_b").alias("written")))).alias("x"), "trace")
    return one(p, "event_type", "position_row.event_type").unionByName(sides.select("x.field", "x.written", "trace").where("written is not null"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """``(field, event_type, trace)`` with catalogue spellings."""
    rows = _written(spark, d)
    mapping = spelling_map(rows.select("written"), spark.read.parquet(f"{d}/activity.parquet"))
    return with_activity(rows, mapping, "written", "event_type").select("field", "event_type", "trace")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Activities that hold at least 5 % of the rows of one of the three fields."""
    return heavy_keys(_fields(spark, d), ["field"], "event_type", "trace", 0.05).select("field", "event_type")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and different traces of each activity in each field."""
    return key_counts(_fields(spark, d), ["field", "event_type"], "trace").select("field", "event_type", "n_rows", F.col("n_values").alias("n_traces"))


def p6_lists(spark: SparkSession, d: str) -> DataFrame:
    """The trace lists of each activity, cut into pieces of bounded size: pieces' sizes and a checksum of their members."""
    pieces = key_lists(_fields(spark, d), ["field", "event_type"], "trace")
    summed = F.aggregate("values", F.lit(0).cast("bigint"), lambda s, x: s + F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint"))
    return pieces.groupBy("field", "event_type").agg(
        F.sum(F.size("values")).cast("bigint").alias("n_traces"),
        F.min(F.element_at("values", 1)).alias("first_trace"),
        F.max(F.element_at("values", -1)).alias("last_trace"),
        F.sum(summed).alias("checksum"),
    )


def cleaned_query(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned log, per activity."""
    log = cleaned.cleaned_log(spark.read.parquet(f"{d}/event_seq.parquet"), spark.read.parquet(f"{d}/activity.parquet"))
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("trace").alias("n_traces"), F.count("ts").alias("n_timed"))


def mine_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All rules of the raw event log, cleaned, that hold in more than 2 % of its traces."""
    log = cleaned.cleaned_log(spark.read.parquet(f"{d}/event_seq.parquet"), spark.read.parquet(f"{d}/activity.parquet"))
    return mine(log, support=0.02)


def branched_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The two activities that most traces of the raw event log, cleaned, lead to from each activity, above 2 % of the traces."""
    log = cleaned.cleaned_log(spark.read.parquet(f"{d}/event_seq.parquet"), spark.read.parquet(f"{d}/activity.parquet"))
    return mine(log, ["response"], support=0.02, branching=Branching("AND", "TARGET", 2))


# ---- readers, writers and runs


def _folder(spark: SparkSession, name: str) -> str:
    from traceloom.session import scratch_dir

    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written_log(write: Callable, read: Callable) -> Query:
    """The user-day log, written in a format and read from it."""

    def q(spark: SparkSession, d: str) -> DataFrame:
        path = _folder(spark, "log")
        write(logs.events_user_day(spark, d), path)
        return read(spark, path).select("trace", "event_type", "pos", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("second"))

    return q


def stored_single_index(spark: SparkSession, d: str) -> DataFrame:
    """The activity index as it is stored, read by its reader."""
    path = _folder(spark, "single")
    logs.single_index(logs.events_user_day(spark, d)).withColumnRenamed("trace", "trace_id").write.parquet(path)
    return logs.read_single_index(spark, path)


def stored_pair_index(spark: SparkSession, d: str) -> DataFrame:
    """The pair index of all pairs of events, stored and read by its reader, per pair of activities."""
    path = _folder(spark, "pairs")
    pairs = logs.full_pair_index(logs.events_user_day(spark, d))
    pairs.selectExpr("event_a as eventA", "event_b as eventB", "trace as trace_id", "pos_a as positionA", "pos_b as positionB").write.parquet(path)
    return logs.read_pair_index(spark, path).groupBy("event_a", "event_b").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("pos_a").alias("sum_a"), F.sum("pos_b").alias("sum_b"))


def stored_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What is remembered of a log, written and read."""
    path = _folder(spark, "meta")
    got = logs.events_user_day(spark, d).agg(F.countDistinct("trace").alias("t"), F.count(F.lit(1)).alias("e"), F.max("ts").cast("string").alias("m")).first()
    logs.write_metadata(spark, logs.RunMetadata("user-day", got.t, got.e, last_declare_mined=got.m), path)
    back = logs.read_metadata(spark, path)
    return spark.createDataFrame([(back.log_name, back.traces, back.events, back.last_declare_mined[:19])], "log_name string, traces bigint, events bigint, last_mined string")


def _state(spark: SparkSession, d: str, hard: bool) -> incremental.MiningState:
    log = logs.events_user_day(spark, d)
    cut = F.to_timestamp_ntz(F.lit(CUT))
    state = incremental.MiningState(spark, _folder(spark, "state"))
    state.update(log.where(F.col("ts") <= cut))
    state.update(log.where(F.col("ts") > cut), hard=hard)
    return state


def watermark(spark: SparkSession, d: str) -> DataFrame:
    """Traces, events and the latest time of the state after two batches."""
    got = _state(spark, d, False).metadata
    return spark.createDataFrame([(got.traces, got.events, got.last_declare_mined[:19])], "traces bigint, events bigint, last_mined string")


def hard_run(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, the second with every trace mined afresh."""
    return _state(spark, d, True).mine()


def command_line(spark: SparkSession, d: str) -> DataFrame:
    """The report that the command line writes of the stored log."""
    from traceloom.plans.cli import parse, run

    path = _folder(spark, "cli")
    logs.write_sequence(logs.events_user_day(spark, d), f"{path}/log")
    return spark.read.text(run(spark, parse(["-l", f"{path}/log", "-s", "0.05", "-o", path]))).select(F.col("value").alias("line"))


def report_with_traces(spark: SparkSession, d: str) -> DataFrame:
    """Report lines of precedence with the ids of the traces, long lists in pieces put together again."""
    f = build_facts(logs.events_user_day(spark, d), keep=True, neighbours=False)
    lines = trace_lines(rule_rows(f, "precedence"), f.n.first()[0])
    parts = F.split("line", r"\|")
    pieces = lines.select(*[parts[i].alias(n) for i, n in enumerate(("rule", "event_a", "event_b"))], F.explode(F.split(parts[3], ",")).alias("trace"), parts[4].alias("share"))
    return pieces.groupBy("rule", "event_a", "event_b", "share").agg(F.count(F.lit(1)).alias("n_traces"), F.min("trace").alias("first_trace"), F.max("trace").alias("last_trace"))


def queries() -> dict[str, Query]:
    ud = logs.events_user_day
    out: dict[str, Query] = {}
    for rule in (*position.RULES, *existence.RULES, *unordered.RULES, *ordered.RULES):
        out[rule.replace(" ", "_").replace("-", "_")] = _support(rule)
    out |= {
        "type_occurrences": lambda s, d: incremental.type_occurrences(ud(s, d)),
        "distinct_traces": lambda s, d: build_facts(ud(s, d), neighbours=False).n.select(F.col("n_all").alias("n_traces")),
        "single_index": lambda s, d: logs.single_index(ud(s, d)),
        "pair_index": lambda s, d: logs.pair_index(ud(s, d)).groupBy("event_a", "event_b").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("pos_a").alias("sum_a"), F.sum("pos_b").alias("sum_b")),
        "activity_matrix": lambda s, d: unordered.pair_counts(build_facts(ud(s, d), neighbours=False)).select("event_a", "event_b", "n_a", "n_b", "n_ab"),
        "new_events": lambda s, d: incremental.new_events(ud(s, d), CUT).select("trace", "event_type", "pos"),
        "trace_bounds": lambda s, d: incremental.trace_bounds(incremental.new_events(ud(s, d), CUT)),
        "affected_events": lambda s, d: incremental.affected_events(ud(s, d), incremental.trace_bounds(incremental.new_events(ud(s, d), CUT))).select("trace", "event_type", "pos"),
        "replaced_rows": _replaced_rows,
        "rule_rows_response": lambda s, d: rule_rows(build_facts(ud(s, d), neighbours=False), "response"),
        "all_constraints": lambda s, d: mine(ud(s, d)),
        "threshold_10_percent": lambda s, d: mine(ud(s, d), list(ordered.RULES), support=0.1),
        "customer_orders_response": lambda s, d: mine(logs.orders_customer(s, d), ["response", "alternate-response", "alternate-precedence"]),
        "user_log_precedence": lambda s, d: mine(logs.events_user(s, d), ["precedence", "alternate-response", "alternate-precedence"]),
        "incremental_position": _incremental(position.RULES),
        "incremental_existence": _incremental(existence.RULES),
        "incremental_unordered": _incremental(unordered.RULES),
        "incremental_ordered": _incremental(ordered.RULES),
        "text_report": lambda s, d: report_lines(mine(ud(s, d))),
        "cleaned_log": cleaned_query,
        "mine_cleaned_log": mine_cleaned,
        "branched_cleaned_log": branched_cleaned,
        "text_log": _written_log(logs.write_with_timestamp, logs.read_with_timestamp),
        "xes_log": _written_log(logs.write_xes, logs.read_xes),
        "sequence_log": _written_log(logs.write_sequence, logs.read_sequence),
        "stored_single_index": stored_single_index,
        "stored_pair_index": stored_pair_index,
        "stored_metadata": stored_metadata,
        "watermark": watermark,
        "hard_run": hard_run,
        "command_line": command_line,
        "report_with_traces": report_with_traces,
        "p6_found": p6_found,
        "p6_counts": p6_counts,
        "p6_lists": p6_lists,
    }
    for policy in ("OR", "AND", "XOR"):
        for side in ("TARGET", "SOURCE"):
            out[f"{policy.lower()}_{side.lower()}_b2"] = _branched(policy, side)
        out[f"{policy.lower()}_unbounded"] = _branched(policy, bound=0)
        out[f"{policy.lower()}_target_b3"] = _branched(policy, bound=3)
    out["chain_and_b2"] = _branched("AND", rule="chain-response")
    out["chain_xor_b2"] = _branched("XOR", rule="chain-response")
    out["chain_and_source_b2"] = _branched("AND", "SOURCE", rule="chain-response")
    out["chain_xor_source_b2"] = _branched("XOR", "SOURCE", rule="chain-response")
    out["chain_and_unbounded"] = _branched("AND", bound=0, rule="chain-response")
    out["chain_xor_unbounded"] = _branched("XOR", bound=0, rule="chain-response")
    out["choice_and_b2"] = _branched("AND", rule="choice")
    out["not_succession_xor_b2"] = _branched("XOR", rule="not-succession")
    out["rare_filter_and_b2"] = _branched("AND", drop_rare=True)
    out["exact_bound_or_b3"] = _branched("OR", bound=3, exact_bound=True)
    out["exactly_source_or_b2"] = _branched("OR", rule="exactly")
    out["first_or_b2"] = _branched("OR", rule="first")
    return out


def _replaced_rows(spark: SparkSession, d: str) -> DataFrame:
    """Position rows of the log before the cut, those of traces with later events replaced."""
    log = logs.events_user_day(spark, d)
    touched = incremental.trace_bounds(incremental.new_events(log, CUT))
    before = log.where(F.col("ts") <= F.to_timestamp_ntz(F.lit(CUT)))
    old = position.position_rows(build_facts(before), "last")
    fresh = position.position_rows(build_facts(incremental.affected_events(log, touched)), "last")
    return incremental.replace_traces(old, fresh, touched).select("rule", "event_a", "trace")


# ---- SQL ----

FACTS = """occ as (select t, e, p, lead(p) over (partition by t, e order by p) as np, lag(p) over (partition by t, e order by p) as pp,
  lead(e) over (partition by t order by p) as ne, lag(e) over (partition by t order by p) as pe from ev),
st as (select t, e, count(*) as c, min(p) as mn, max(p) as mx, count(ne) as cne, min(ne) as mine, max(ne) as maxe, count(pe) as cpe, min(pe) as minp, max(pe) as maxp from occ group by t, e),
n as (select count(distinct t) as n from ev), ty as (select e, count(*) as n from st group by e)"""


def _log_sql(table: str, trace: str, activity: str, order: str) -> str:
    return f"ev as (select {trace} as t, {activity} as e, row_number() over (partition by {trace} order by {order}) - 1 as p from {table}), {FACTS}"


LOG_OF_CLEANED = "ev as (select trace as t, event_type as e, pos as p from cl)"


USER_DAY = _log_sql("events", "user_id::varchar || '-' || ts::date::varchar", "event_type", "ts, event_id")
USER = _log_sql("events", "user_id::varchar", "event_type", "ts, event_id")
CUSTOMER = _log_sql("orders", "o_custkey::varchar", "o_orderpriority", "o_orderdate, o_orderkey")

RESPONSE = "select x.e as a, y.e as b, x.t from st x join st y using (t) where x.mn < y.mx"
PRECEDENCE = "select x.e as a, y.e as b, x.t from st x join st y using (t) where (x.e <> y.e and x.mn < y.mn) or (x.e = y.e and x.c >= 2)"
ALT_RESPONSE = """select a, b, t from (select x.e as a, y.e as b, x.t, count(distinct x.p) as k from occ x join occ y on x.t = y.t and x.e <> y.e and y.p > x.p and (x.np is null or y.p < x.np)
  group by x.e, y.e, x.t) g join st on st.t = g.t and st.e = g.a where k = c"""
ALT_RESPONSE = ALT_RESPONSE.replace("select a, b, t from", "select a, b, g.t from", 1)
ALT_PRECEDENCE = """select a, b, g.t from (select x.e as a, y.e as b, x.t, count(distinct y.p) as k from occ x join occ y on x.t = y.t and x.e <> y.e and x.p < y.p and (y.pp is null or x.p > y.pp)
  group by x.e, y.e, x.t) g join st on st.t = g.t and st.e = g.b where k = c union all select e, e, t from st where c >= 2"""
CHAIN_RESPONSE = "select e as a, mine as b, t from st where cne = c and mine = maxe and mine <> e"
CHAIN_PRECEDENCE = "select minp as a, e as b, t from st where cpe = c and minp = maxp and minp <> e"
ROWS = {
    "response": RESPONSE,
    "precedence": PRECEDENCE,
    "succession": f"({RESPONSE}) intersect ({PRECEDENCE})",
    "alternate-response": ALT_RESPONSE,
    "alternate-precedence": ALT_PRECEDENCE,
    "alternate-succession": f"({ALT_RESPONSE}) intersect ({ALT_PRECEDENCE})",
    "chain-response": CHAIN_RESPONSE,
    "chain-precedence": CHAIN_PRECEDENCE,
    "chain-succession": f"({CHAIN_RESPONSE}) intersect ({CHAIN_PRECEDENCE})",
    "not-chain-succession": f"({ALT_RESPONSE}) except ({CHAIN_RESPONSE})",
    "not-succession": f"select a, b, v.t from (select distinct a, b from ({RESPONSE})) cross join (select distinct t from ev) v except ({RESPONSE})",
    "responded existence": "select x.e as a, y.e as b, x.t from st x join st y using (t)",
    "first": "select e as a, null::varchar as b, t from ev where p = 0",
    "last": "select e as a, null::varchar as b, t from (select *, max(p) over (partition by t) as m from ev) where p = m and m > 0",
}
MATRIX = "(select x.e as a, y.e as b, x.n as na, y.n as nb, coalesce(k, 0) as nab, n.n as n from ty x cross join ty y cross join n left join (select u.e as a, v.e as b, count(*) as k from st u join st v using (t) group by 1, 2) m on m.a = x.e and m.b = y.e)"
COUNTS = {
    "co-existence": f"select a, b, n - na - nb + 2 * nab as k from {MATRIX}",
    "not co-existence": f"select a, b, case when a < b then n - nab else n - na - nb + nab end as k from {MATRIX}",
    "choice": f"select a, b, na + nb - nab as k from {MATRIX} where a < b",
    "exclusive choice": f"select a, b, na + nb - 2 * nab as k from {MATRIX} where a < b",
    "exactly": "select e as a, c::varchar as b, count(*) as k from st group by e, c",
    "existence": "select k.e as a, k.c::varchar as b, count(*) as k from (select distinct e, c from st) k join st on st.e = k.e and st.c >= k.c group by k.e, k.c",
    "absence": "select z.e as a, z.c::varchar as b, n - (select count(*) from st where st.e = z.e and st.c >= z.c) as k from (select distinct e, c from st union select e, max(c) + 1 from st group by e) z cross join n",
}


#: For logs of many activities, where all traces of all pairs are too many.
NOT_SUCCESSION = f"select a, b, (select n from n) - count(*) as k from ({RESPONSE}) group by a, b"


def _counts_sql(rule: str, many: bool = False) -> str:
    inner = NOT_SUCCESSION if many and rule == "not-succession" else COUNTS.get(rule) or f"select a, b, count(*) as k from ({ROWS[rule]}) group by a, b"
    return f"select '{rule}' as rule, a as event_a, b as event_b, k::bigint as n_traces, k / (select n from n)::double as support from ({inner}) where k > 0"


def _sql(rule: str, log: str = USER_DAY) -> str:
    return f"with {log} {_counts_sql(rule)}"


def _all_sql(rules, log: str = USER_DAY, where: str = "true") -> str:
    return f"with {log} select * from ({' union all '.join(_counts_sql(r) for r in rules)}) where {where}"


EXACT = "select e as a, c::varchar as b, t from st"


def _branch_rows(side: str, rule: str) -> str:
    """``(f, o, t)``: group, operand, trace. Position rules merge their activities in one group of no name."""
    rows = EXACT if rule == "exactly" else ROWS[rule]
    f, o = ("a", "b") if side == "TARGET" else ("b", "a")
    if rule in ("first", "last"):
        f, o = "''", "a"
    return f"r as (select distinct {f} as f, {o} as o, t from ({rows}))"


def _branch_out(side: str, rule: str, table: str, where: str = "true") -> str:
    return f"""select '{rule}' as rule, '{side}' as side, nullif(f, '') as fixed, array_to_string(list_sort(m), ',') as merged, k::bigint as n_traces, k / (select n from n)::double as support
from {table} where k > 0 and {where}"""


def _set_branch_sql(policy: str, side: str, bound: int = 2, rule: str = "response", rare: bool = False, rounds: int = 4) -> str:
    """Best pair per group under AND or XOR, then the best extension each round; a group of one operand keeps it. bound 0: unbounded."""
    holds = (lambda n: f"count(*) = {n}") if policy == "AND" else (lambda n: "count(*) % 2 = 1")
    start = "ops as (select distinct f, o from r), start as (select * from ops)"
    if rare:
        start = """ops as (select distinct f, o from r), hits as (select f, t, count(*) as h from r group by f, t), top as (select f, max(h) as h from hits group by f),
start as (select distinct r.f, r.o from r join hits using (f, t) join top on top.f = r.f and top.h = hits.h)"""
    sql = f"""with {USER_DAY}, {_branch_rows(side, rule)}, {start},
pair as (select x.f, [x.o, y.o] as m from start x join start y on x.f = y.f and x.o < y.o),
held as (select p.f, p.m, r.t from pair p join r on r.f = p.f and list_contains(p.m, r.o) group by p.f, p.m, r.t having {holds(2)}),
size2 as (select pair.f, pair.m, count(held.t) as k from pair left join held on held.f = pair.f and held.m = pair.m group by pair.f, pair.m),
best as (select f, m, k from (select *, row_number() over (partition by f order by k desc, m) as rk from size2) where rk = 1),
alone as (select r.f, [min(r.o)] as m, count(*) as k from r join start using (f, o) group by r.f having count(distinct r.o) = 1),
single as (select f, [o] as m, k from (select f, o, count(*) as k, row_number() over (partition by f order by count(*) desc, o) as rk from r join start using (f, o) group by f, o) where rk = 1),
s2 as (select * from best {"where k > 0 union all select single.* from single join best using (f) where best.k = 0" if bound == 0 else ""})"""
    last = max(2, bound) if bound else rounds + 1
    for i in range(2, last):
        more = "c.k > 1" if bound else f"c.k > 1 and c.k = s.k and s.k > {1 if policy == 'AND' else 0}"
        sql += f""", c{i} as (select f, m, o, count(*) as k from (select s.f, s.m, p.o, r.t from s{i} s join ops p on p.f = s.f and not list_contains(s.m, p.o) join r on r.f = s.f and (list_contains(s.m, r.o) or r.o = p.o)
  where len(s.m) = {i} and s.k > 0 group by s.f, s.m, p.o, r.t having {holds(i + 1)}) group by f, m, o),
s{i + 1} as (select s.f, case when c.k is null then s.m else list_append(c.m, c.o) end as m, coalesce(c.k, s.k) as k from s{i} s left join
  (select c.* from (select *, row_number() over (partition by f order by k desc, o) as rk from c{i}) c join s{i} s using (f) where rk = 1 and {more}) c on c.f = s.f)"""
    return f"{sql}, fin as (select * from s{last} union all select * from alone) {_branch_out(side, rule, 'fin')}"


def _or_branch_sql(side: str, bound: int = 2, rule: str = "response", where: str = "true") -> str:
    """Weakest operand dropped until ``bound`` are left; five activities need no more than three rounds."""
    rounds = ""
    for i in range(5 - bound):
        rounds += f"""own{i} as (select o{i}.f, o{i}.o, count(s.t) as k from (select distinct f, o from r{i}) o{i} left join (select f, t, min(o) as o from r{i} group by f, t having count(*) = 1) s on s.f = o{i}.f and s.o = o{i}.o group by o{i}.f, o{i}.o),
drop{i} as (select f, o from (select *, row_number() over (partition by f order by k, o) as rk, count(*) over (partition by f) as m from own{i}) where rk = 1 and m > {bound}),
r{i + 1} as (select r{i}.* from r{i} anti join drop{i} using (f, o)),
"""
    return f"""with {USER_DAY}, {_branch_rows(side, rule)}, r0 as (select * from r),
{rounds}fin as (select f, list(distinct o) as m, count(distinct t) as k from r{5 - bound} group by f) {_branch_out(side, rule, "fin", where)}"""


def _or_unbounded_sql(side: str = "TARGET", rule: str = "response", factor: float = 1.5) -> str:
    """Up to five operands: the first three losses cannot stand out, so two operands are left, or three if the fourth loss does."""
    sql = f"with {USER_DAY}, {_branch_rows(side, rule)}, r0 as (select * from r)"
    for i in range(4):
        sql += f""", own{i} as (select o{i}.f, o{i}.o, count(s.t) as k from (select distinct f, o from r{i}) o{i} left join (select f, t, min(o) as o from r{i} group by f, t having count(*) = 1) s on s.f = o{i}.f and s.o = o{i}.o group by o{i}.f, o{i}.o),
drop{i} as (select f, o, k from (select *, row_number() over (partition by f order by k, o) as rk, count(*) over (partition by f) as m from own{i}) where rk = 1 and m > 1),
r{i + 1} as (select r{i}.* from r{i} anti join (select f, o from own{i} where false union all select f, o from drop{i} where (select count(*) from own{i} x where x.f = drop{i}.f) > 2) d using (f, o))"""
    losses = " union all ".join(f"select f, {i} as i, k from drop{i} where (select count(*) from own{i} x where x.f = drop{i}.f) = {5 - i}" for i in range(4))
    return f"""{sql}, loss as ({losses}), stat as (select f, count(*) as c, avg(k) as mean, stddev_pop(k) as sd, arg_max(k, i) as last from loss group by f),
early as (select f from stat where c = 4 and abs(last - mean) > {factor} * sd + 1e-9),
fin as (select f, list(distinct o) as m, count(distinct t) as k from r2 where f in (select f from early) group by f
  union all select f, list(distinct o) as m, count(distinct t) as k from r3 where f not in (select f from early) group by f) {_branch_out(side, rule, "fin")}"""


def _chain_branch_sql(policy: str, side: str = "TARGET", bound: int = 2, rule: str = "chain-response", base: str = "response", rounds: int = 6) -> str:
    """From an operand of the chain rule along the rows of the base rule, one step a round. bound 0: as long as an added activity keeps all traces."""
    f, o = ("a", "b") if side == "TARGET" else ("b", "a")
    sql = f"""with {USER_DAY}, r as materialized (select distinct {f} as f, {o} as o, t from ({ROWS[rule]})), l as materialized (select distinct a, b, t from ({ROWS[base]})), lo as (select distinct a, b from l),
one as (select f, [min(o)] as m, count(*) as k from r group by f having count(distinct o) = 1),
c1 as (select f, [o] as m, o as tail, t from r where f not in (select f from one)), s1 as (select f, [''] as m, 0 as k, 0 as had from one where false)"""
    last = bound or rounds
    for i in range(2, last + 1):
        own = f"(select c.f, c.m, c.tail, lo.b as nxt, c.t from c{i - 1} c join lo on lo.a = c.tail)"
        if policy == "AND":
            cand = f"select x.* from {own} x semi join l on l.a = x.tail and l.b = x.nxt and l.t = x.t"
        else:
            cand = f"""select f, m, tail, nxt, t from (select * from {own} union all select x.f, x.m, x.tail, l.b, l.t from (select distinct f, m, tail from c{i - 1}) x join l on l.a = x.tail)
group by f, m, tail, nxt, t having count(*) = 1"""
        keep = f"s.f is null or ({'c.k > 0' if bound else 'c.k = s.k and c.k > 0 and len(c.m) > len(s.m)'})"
        sql += f""", d{i} as materialized (select f, case when list_contains(m, nxt) then m else list_append(m, nxt) end as m, nxt as tail, t from ({cand})),
z{i} as (select f, m, tail, count(*) as k from d{i} group by f, m, tail),
b{i} as materialized (select c.* from (select * from z{i} qualify row_number() over (partition by f order by k desc, m) = 1) c left join s{i - 1} s using (f) where {keep}),
c{i} as materialized (select d.* from d{i} d semi join b{i} b on b.f = d.f and b.m = d.m and b.tail = d.tail),
s{i} as materialized (select f, m, k, 0 as had from b{i} union all select s.* from s{i - 1} s anti join b{i} using (f))"""
    return f"{sql}, fin as (select f, m, k from s{last} union all select f, m, k from one) {_branch_out(side, rule, 'fin')}"


def _rows_branch_sql(policy: str, rule: str, rows: str, log: str = USER_DAY, where: str = "true") -> str:
    """The best pair of targets of each activity, from pair counts: for logs of many activities."""
    size = "coalesce(p.k, 0)" if policy == "AND" else "x.n + y.n - 2 * coalesce(p.k, 0)"
    return f"""with {log}, r as materialized (select distinct a as f, b as o, t from ({rows})), own as (select f, o, count(*) as n from r group by f, o),
p as (select x.f, x.o as o, y.o as u, count(*) as k from r x join r y on x.f = y.f and x.t = y.t and x.o < y.o group by 1, 2, 3),
c as (select x.f, [x.o, y.o] as m, {size} as k from own x join own y on x.f = y.f and x.o < y.o left join p on p.f = x.f and p.o = x.o and p.u = y.o),
fin as (select f, m, k from c qualify row_number() over (partition by f order by k desc, m) = 1 union all select f, [min(o)], sum(n) from own group by f having count(*) = 1) {_branch_out("TARGET", rule, "fin", where)}"""


#: Each written name of the activity columns with its catalogue spelling; ``written`` has to be a relation of one column w.
MAPPING = r"""ac as (select event_type as a, regexp_replace(lower(event_type), '[^\p{L}]', '', 'g') as k from activity where event_type is not null),
keys as (select distinct regexp_replace(lower(w), '[^\p{L}]', '', 'g') as k from written),
near as (select keys.k, arg_min(ac.a, (levenshtein(keys.k, ac.k), ac.a)) as a from keys cross join ac group by keys.k)"""
CLEANED = rf"""written as (select distinct event_type as w from event_seq where event_type is not null), {MAPPING},
last as (select trace, pos, arg_max(event_type, (coalesce(arrived_at, timestamp '0001-01-01'), event_type, coalesce(ts, ''))) as w, arg_max(coalesce(ts, ''), (coalesce(arrived_at, timestamp '0001-01-01'), event_type, coalesce(ts, ''))) as ts
  from event_seq where trace is not null and event_type is not null and pos is not null group by trace, pos),
cl as (select trace, pos, near.a as event_type, try_cast(nullif(ts, '') as timestamp) as ts from last join near on near.k = regexp_replace(lower(w), '[^\p{{L}}]', '', 'g'))"""
FIELDS = rf"""raw as (select 'position_row.event_type' as field, event_type as w, trace from position_row union all select 'pair_row.event_a', event_a, trace from pair_row union all select 'pair_row.event_b', event_b, trace from pair_row),
written as (select distinct w from raw where w is not null), {MAPPING},
fl as (select field, near.a as event_type, trace from raw join near on near.k = regexp_replace(lower(w), '[^\p{{L}}]', '', 'g') where w is not null)"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for rule in (*position.RULES, *unordered.RULES, *ordered.RULES, *existence.RULES):
        sql = _sql(rule)
        if rule in position.RULES:
            sql = f"select rule, event_a, n_traces, support from ({sql})"
        if rule in existence.RULES:
            sql = f"select rule, event_a, event_b::bigint as instances, n_traces, support from ({sql})"
        out[rule.replace(" ", "_").replace("-", "_")] = sql
    every = (*position.RULES, *existence.RULES, *unordered.RULES, *ordered.RULES)
    fresh = f"ts > timestamp '{CUT}'"
    second = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
    tr = "user_id::varchar || '-' || ts::date::varchar"
    evt = f"(select {tr} as trace, event_type, (row_number() over (partition by {tr} order by ts, event_id) - 1)::int as pos, ts from events)"
    out |= {
        "type_occurrences": "select event_type, count(*) as n_events from events group by event_type",
        "distinct_traces": f"select count(distinct {tr}) as n_traces from events",
        "single_index": f"select distinct event_type, {tr} as trace from events",
        "pair_index": f"with {USER_DAY} select a as event_a, b as event_b, count(*) as n_pairs, sum(pa)::bigint as sum_a, sum(pb)::bigint as sum_b from (select x.e as a, y.e as b, y.t, max(x.p) as pa, y.p as pb from occ x join occ y on x.t = y.t and x.p < y.p group by x.e, y.e, y.t, y.p) group by 1, 2",
        "activity_matrix": f"with {USER_DAY} select a as event_a, b as event_b, na as n_a, nb as n_b, nab as n_ab from {MATRIX}",
        "new_events": f"select trace, event_type, pos from {evt} where {fresh}",
        "trace_bounds": f"select trace, min(pos) as min_pos, max(pos) as max_pos from {evt} where {fresh} group by trace",
        "affected_events": f"select trace, event_type, pos from {evt} where trace in (select trace from {evt} where {fresh})",
        "replaced_rows": f"with {USER_DAY} select 'last' as rule, a as event_a, t as trace from ({ROWS['last']})",
        "rule_rows_response": f"with {USER_DAY} select 'response' as rule, a as event_a, b as event_b, t as trace from ({RESPONSE})",
        "all_constraints": _all_sql(every),
        "threshold_10_percent": _all_sql(ordered.RULES, where="support > 0.1"),
        "customer_orders_response": _all_sql(("response", "alternate-response", "alternate-precedence"), CUSTOMER),
        "user_log_precedence": _all_sql(("precedence", "alternate-response", "alternate-precedence"), USER),
        "incremental_position": _all_sql(position.RULES),
        "incremental_existence": _all_sql(existence.RULES),
        "incremental_unordered": _all_sql(unordered.RULES),
        "incremental_ordered": _all_sql(ordered.RULES),
        "text_report": f"select concat_ws('|', rule, event_a, event_b, n_traces::varchar, printf('%.3f', support)) as line from ({_all_sql(every)})",
        "cleaned_log": f"with {CLEANED} select event_type, count(*) as n_events, count(distinct trace) as n_traces, count(ts) as n_timed from cl group by event_type",
        "mine_cleaned_log": f"with {CLEANED}, {LOG_OF_CLEANED}, {FACTS} select * from ({' union all '.join(_counts_sql(r, True) for r in every)}) where support > 0.02",
        "p6_found": f"with {FIELDS} select field, event_type from (select field, event_type, count(*) as k, sum(count(*)) over (partition by field) as total from fl group by field, event_type) where k >= 0.05 * total",
        "p6_counts": f"with {FIELDS} select field, event_type, count(*) as n_rows, count(distinct trace) as n_traces from fl group by field, event_type",
        "p6_lists": f"with {FIELDS} select field, event_type, count(*) as n_traces, min(trace) as first_trace, max(trace) as last_trace, sum(('0x' || substr(md5(trace), 1, 8))::bigint)::bigint as checksum from (select distinct field, event_type, trace from fl where trace is not null) group by field, event_type",
    }
    for kind in ("text_log", "xes_log", "sequence_log"):
        out[kind] = f"select trace, event_type, pos, {second} as second from {evt}"
    whole = f"count(distinct trace) as traces, count(*) as events, max({second}) as last_mined from {evt}"
    out |= {
        "stored_single_index": out["single_index"],
        "stored_pair_index": f"with {USER_DAY} select x.e as event_a, y.e as event_b, count(*) as n_pairs, sum(x.p)::bigint as sum_a, sum(y.p)::bigint as sum_b from occ x join occ y on x.t = y.t and x.p < y.p group by 1, 2",
        "stored_metadata": f"select 'user-day' as log_name, {whole}",
        "watermark": f"select {whole}",
        "hard_run": _all_sql(every),
        "command_line": f"select concat_ws('|', rule, event_a, event_b, n_traces::varchar, printf('%.3f', support)) as line from ({_all_sql(every, where='support > 0.05')})",
        "report_with_traces": f"with {USER_DAY} select 'precedence' as rule, a as event_a, b as event_b, printf('%.3f', count(*) / (select n from n)::double) as share, count(*) as n_traces, min(t) as first_trace, max(t) as last_trace from ({PRECEDENCE}) group by a, b",
    }
    for side in ("TARGET", "SOURCE"):
        out[f"or_{side.lower()}_b2"] = _or_branch_sql(side)
        out[f"and_{side.lower()}_b2"] = _set_branch_sql("AND", side)
        out[f"xor_{side.lower()}_b2"] = _set_branch_sql("XOR", side)
    out |= {
        "or_target_b3": _or_branch_sql("TARGET", 3),
        "exact_bound_or_b3": _or_branch_sql("TARGET", 3, where="len(m) = 3"),
        "first_or_b2": _or_branch_sql("TARGET", 2, "first"),
        "exactly_source_or_b2": _or_branch_sql("SOURCE", 2, "exactly"),
        "or_unbounded": _or_unbounded_sql(),
        "and_target_b3": _set_branch_sql("AND", "TARGET", 3),
        "xor_target_b3": _set_branch_sql("XOR", "TARGET", 3),
        "and_unbounded": _set_branch_sql("AND", "TARGET", 0),
        "xor_unbounded": _set_branch_sql("XOR", "TARGET", 0),
        "rare_filter_and_b2": _set_branch_sql("AND", "TARGET", 2, rare=True),
        "chain_and_b2": _chain_branch_sql("AND"),
        "chain_xor_b2": _chain_branch_sql("XOR"),
        "chain_and_source_b2": _chain_branch_sql("AND", "SOURCE"),
        "chain_xor_source_b2": _chain_branch_sql("XOR", "SOURCE"),
        "chain_and_unbounded": _chain_branch_sql("AND", bound=0),
        "chain_xor_unbounded": _chain_branch_sql("XOR", bound=0),
        "choice_and_b2": _rows_branch_sql("AND", "choice", "select x.e as a, y.e as b, v.t from ty x join ty y on x.e < y.e cross join (select distinct t from ev) v where exists (select 1 from st where st.t = v.t and st.e in (x.e, y.e))"),
        "not_succession_xor_b2": _rows_branch_sql("XOR", "not-succession", ROWS["not-succession"]),
        "branched_cleaned_log": _rows_branch_sql("AND", "response", RESPONSE, f"{CLEANED}, {LOG_OF_CLEANED}, {FACTS}", "k / (select n from n)::double > 0.02"),
    }
    return out
