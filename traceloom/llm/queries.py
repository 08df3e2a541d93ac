"""The pN_ queries over the driver's tables, with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import distinct, leaks, pairs, patterns, runs, sets, similar, stuffing, tokens
from traceloom.sources.cleaned import cleaned_log

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sets(s: SparkSession, d: str) -> DataFrame:
    return sets.constraint_sets(_read(s, d, "pair_constraint"), _read(s, d, "position_constraint"))


# 1


def p1_found(s: SparkSession, d: str) -> DataFrame:
    """Constraints of either table whose trace sets have a Jaccard similarity of at least 0.7."""
    found = similar.similar_pairs(_sets(s, d).select("id", "members"), 0.7)
    return found.select(F.col("id_a").alias("constraint_id_a"), F.col("id_b").alias("constraint_id_b"))


def p1_classes(s: SparkSession, d: str) -> DataFrame:
    """Each constraint with its class of equal sets and the number of similar classes."""
    reps, membership = similar.classes(_sets(s, d).select("id", "members"))
    links = similar.class_pairs(reps, 0.7)
    ends = links.select(F.col("rep_a").alias("rep")).unionByName(links.select(F.col("rep_b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return membership.join(degree, "rep", "left").select(F.col("id").alias("constraint_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


# 2


def _patterns(s: SparkSession, d: str, **kw) -> DataFrame:
    log = cleaned_log(_read(s, d, "event_seq"), _read(s, d, "activity"), runs.CHUNK)
    return patterns.frequent_patterns(log, 0.05, **kw)


def p2_found(s: SparkSession, d: str) -> DataFrame:
    """Orders of 3 to 5 different activities that at least 5 % of the traces go through."""
    return _patterns(s, d, shortest=3, longest=5, distinct=True, closed=False).select(F.array_join("steps", " > ").alias("pattern"))


def p2_closed(s: SparkSession, d: str) -> DataFrame:
    """All frequent patterns with their supports, closed ones marked."""
    return _patterns(s, d).select(F.array_join("steps", " > ").alias("pattern"), "n_traces", "closed")


def p2_short(s: SparkSession, d: str) -> DataFrame:
    """Frequent patterns of up to 3 steps with their supports, closed ones marked."""
    return _patterns(s, d, longest=3).select(F.array_join("steps", " > ").alias("pattern"), "n_traces", "closed")


# 3


def _runs(s: SparkSession, d: str) -> DataFrame:
    return runs.cleaned_runs(_read(s, d, "event_seq"), _read(s, d, "activity"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    """Longest stretches of at least two neighbouring events of one activity."""
    return _runs(s, d).where("n_events >= 2").select("trace", F.col("first_pos").cast("int").alias("first_pos"), F.col("last_pos").cast("int").alias("last_pos"))


def p3_runs(s: SparkSession, d: str) -> DataFrame:
    """The whole log with every run collapsed into one event with its count and duration."""
    return _runs(s, d).select("trace", "event_type", "first_pos", "last_pos", "n_events", "duration_s")


# 4


def _pairs(s: SparkSession, d: str, count: int, share: float) -> DataFrame:
    baskets = pairs.activity_baskets(_read(s, d, "pair_row").select("event_a", "event_b", "trace"), _read(s, d, "activity"))
    return pairs.cooccurrences(baskets, count, share)


def p4_found(s: SparkSession, d: str) -> DataFrame:
    """Pairs of activities that share at least 6 traces and 1 % of all, three times as many as by chance."""
    return pairs.associated(_pairs(s, d, 6, 0.01), 3).select("item_a", "item_b")


def p4_pairs(s: SparkSession, d: str) -> DataFrame:
    """Every pair of activities that shares a trace, with its counts and lift."""
    return _pairs(s, d, 1, 0.0).select("item_a", "item_b", "n_ab", "n_a", "n_b", "lift")


# 5


def _members(s: SparkSession, d: str) -> DataFrame:
    day = F.date_format("mined_at", "yyyy-MM-dd").alias("mined_day")
    return _sets(s, d).select("rule", day, F.explode("members").alias("trace"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    """Rules and days with fewer than half as many different traces as members."""
    return distinct.low_diversity(_members(s, d), ["rule", "mined_day"], "trace", 0.5).select("rule", "mined_day")


def p5_unions(s: SparkSession, d: str) -> DataFrame:
    """Estimates per rule and day, per rule, per day and overall, all merged from the sketches by rule and day."""
    from traceloom.session import materialize

    fine = materialize(distinct.sketch(_members(s, d).dropna(subset=["rule", "mined_day"]), ["rule", "mined_day"], "trace"))
    none = F.lit(None).cast("string")
    by = distinct.estimate(fine, ["rule", "mined_day"])
    rule = distinct.estimate(distinct.merge(fine, ["rule"]), ["rule"]).withColumn("mined_day", none)
    day = distinct.estimate(distinct.merge(fine, ["mined_day"]), ["mined_day"]).withColumn("rule", none)
    every = distinct.estimate(distinct.merge(fine, []), []).withColumn("mined_day", none).withColumn("rule", none)
    out = by.unionByName(rule).unionByName(day).unionByName(every)
    return out.withColumn("error_bound", F.lit(distinct.ERROR_BOUND)).select("rule", "mined_day", "n_distinct", "error_bound")


def p5_within(s: SparkSession, d: str) -> DataFrame:
    """The estimates of ``p5_unions`` held against exact counts: whether each is within the error bound."""
    rows = _members(s, d).dropna(subset=["rule", "mined_day"])
    exact = rows.cube("rule", "mined_day").agg(F.countDistinct("trace").alias("_n")).select(F.col("rule").alias("_r"), F.col("mined_day").alias("_d"), "_n")
    both = p5_unions(s, d).join(exact, F.col("rule").eqNullSafe(F.col("_r")) & F.col("mined_day").eqNullSafe(F.col("_d")), "full")
    return both.select(F.col("_r").alias("rule"), F.col("_d").alias("mined_day"), F.coalesce(F.abs(F.col("n_distinct") / F.col("_n") - 1) <= F.col("error_bound"), F.lit(False)).alias("within"))


# 7


def p7_ids(s: SparkSession, d: str) -> DataFrame:
    """Token ids of every page."""
    return tokens.encode(_read(s, d, "documents"))


def p7_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Pages per outcome of encoding and decoding again."""
    docs = _read(s, d, "documents").select("doc_id", "text")
    back = tokens.decoded(tokens.encode(docs)).withColumnRenamed("text", "_back")
    same = docs.join(back, "doc_id").select((F.coalesce("text", F.lit("")) == F.col("_back")).alias("same"))
    return same.groupBy("same").agg(F.count(F.lit(1)).alias("n_pages"))


# 8


def p8_found(s: SparkSession, d: str) -> DataFrame:
    """Pages that print at least 22 consecutive words of a test passage, and the passage's item."""
    return leaks.leaks(_read(s, d, "documents"), _read(s, d, "eval_item")).select("doc_id", "item_id")


def p8_items(s: SparkSession, d: str) -> DataFrame:
    """Test items that leaked: pages and the most words in a row."""
    found = leaks.leaks(_read(s, d, "documents"), _read(s, d, "eval_item"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_pages"), F.max("n_words").alias("n_words"))


# 9


def p9_found(s: SparkSession, d: str) -> DataFrame:
    """Pages of which more than half the words are repeated keywords, links or product tags."""
    return stuffing.stuffed_pages(_read(s, d, "documents")).select("doc_id")


def p9_curves(s: SparkSession, d: str) -> DataFrame:
    """The rank-frequency fit and divergence of every page."""
    from traceloom.session import materialize

    counts = materialize(stuffing.page_counts(_read(s, d, "documents")))
    return stuffing.page_curves(counts, stuffing.vocabulary(counts)).withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from traceloom.llm.oracle import SQL

    return dict(SQL)
