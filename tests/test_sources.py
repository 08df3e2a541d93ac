import datetime as dt

from traceloom.functions.activities import spelling_map, with_activity
from traceloom.sources import logs
from traceloom.sources.cleaned import cleaned_log, event_time

XES = """<?xml version="1.0"?><log>
<trace><string key="concept:name" value="A1"/>
 <event><string key="concept:name" value="x"/><date key="time:timestamp" value="2016-01-01T09:51:15.304+00:00"/><int key="@@index" value="0"/></event>
 <event><string key="org" value="u"/><string key="concept:name" value="y"/><date key="time:timestamp" value="2016-01-01T09:51:15.304+00:00"/></event>
</trace>
<trace><string key="concept:name" value="A2"/><event><string key="concept:name" value="z"/><date key="time:timestamp" value="2016-01-02T00:00:00.000+00:00"/></event></trace>
</log>"""


def test_xes_keeps_document_order(spark, tmp_path):
    (tmp_path / "l.xes").write_text(XES)
    rows = {(r.trace, r.pos): (r.event_type, r.ts) for r in logs.read_xes(spark, str(tmp_path / "l.xes")).collect()}
    t = dt.datetime(2016, 1, 1, 9, 51, 15, 304000)
    assert rows == {("A1", 0): ("x", t), ("A1", 1): ("y", t), ("A2", 0): ("z", dt.datetime(2016, 1, 2))}


def test_indexed_tables_and_metadata(spark, tmp_path):
    spark.createDataFrame([("t", "2024-01-01 00:00:00", "a", 0)], "trace_id string, timestamp string, event_type string, position int").write.parquet(str(tmp_path / "seq"))
    assert logs.read_sequence(spark, str(tmp_path / "seq")).first() == ("t", "a", dt.datetime(2024, 1, 1), 0)
    spark.createDataFrame([("a", "t")], "event_type string, trace_id string").write.parquet(str(tmp_path / "single"))
    assert logs.read_single_index(spark, str(tmp_path / "single")).first() == ("a", "t")
    spark.createDataFrame([("a", "b", 0, 1, "t")], "eventA string, eventB string, positionA int, positionB int, trace_id string").write.parquet(str(tmp_path / "idx"))
    assert logs.read_pair_index(spark, str(tmp_path / "idx")).first() == ("a", "b", "t", 0, 1)
    assert logs.read_metadata(spark, str(tmp_path / "none")) == logs.RunMetadata()
    m = logs.RunMetadata(log_name="l", traces=3, last_declare_mined="2024-01-01")
    logs.write_metadata(spark, m, str(tmp_path / "meta"))
    assert logs.read_metadata(spark, str(tmp_path / "meta")) == m


def test_pair_index_is_nearest(spark, tiny):
    got = {(r.event_a, r.event_b, r.pos_a, r.pos_b) for r in logs.pair_index(tiny).where("trace = 't2'").collect()}
    assert got == {("a", "b", 0, 1), ("a", "a", 0, 2), ("b", "a", 1, 2), ("a", "b", 2, 3), ("b", "b", 1, 3)}


def test_spellings(spark):
    cat = spark.createDataFrame([("Notify Quarry",), ("Verify Quarry",), (None,)], "event_type string")
    written = ["Notify Quarry", "notify_quarry", "NOTIFY QUARRY [3x]", "Ntify Quary", "verifyquarry - again", "", None, "..."]
    m = spelling_map(spark.createDataFrame([(w,) for w in written], "written string"), cat)
    got = {r.written: r.activity for r in m.collect()}
    assert got == {"Notify Quarry": "Notify Quarry", "notify_quarry": "Notify Quarry", "NOTIFY QUARRY [3x]": "Notify Quarry", "Ntify Quary": "Notify Quarry", "verifyquarry - again": "Verify Quarry", "": "Notify Quarry", "...": "Notify Quarry"}
    assert {r.activity for r in spelling_map(spark.createDataFrame([("x",)], "written string"), cat.limit(0)).collect()} == {None}
    assert with_activity(spark.createDataFrame([(None,), ("",)], "event_type string"), m).where("activity is null").count() == 1


def test_cleaning(spark):
    t = dt.datetime
    rows = [("t", "Notify Quarry", "2024-01-01T00:00:00.500", 0, t(2024, 1, 1)), ("t", "verify quarry", "bad", 0, t(2024, 1, 2)), ("t", "notify quarry", "2024-01-01 00:00:01", 3, None),
            (None, "x", None, 0, None), ("t", None, None, 1, None), ("t", "x", None, None, None), ("t", "notify quarry", "2024-01-01 00:00:01", 3, None)]
    ev = spark.createDataFrame(rows, "trace string, event_type string, ts string, pos int, arrived_at timestamp_ntz")
    cat = spark.createDataFrame([("Notify Quarry",), ("Verify Quarry",)], "event_type string")
    for chunk in (None, 2):
        got = sorted((r.trace, r.pos, r.event_type, r.ts) for r in cleaned_log(ev, cat, chunk).collect())
        assert got == [("t", 0, "Verify Quarry", None), ("t", 3, "Notify Quarry", t(2024, 1, 1, 0, 0, 1))]
    assert cleaned_log(ev.limit(0), cat).count() == 0
    assert ev.select(event_time(ev.ts).alias("x")).where("x is not null").count() == 3


def test_numbering_in_chunks(spark):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(3)
    rows = [(rnd.choice("xyz"), rnd.choice(["a", "b", None]), t) for t in range(300)] + [(None, "a", 1), ("x", "a", None)]
    df = spark.createDataFrame(rows, "k string, e string, t int")
    plain = logs.event_log(df, F.col("k"), F.col("e"), ["t"])
    chunked = logs.event_log(df, F.col("k"), F.col("e"), ["t"], chunk=F.floor(F.col("t") / 7))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, chunked.collect()), key=str)
    assert chunked.groupBy("trace").agg(F.max("pos") + 1, F.count("pos"), F.countDistinct("pos")).where("(max(pos) + 1) <> count(pos)").count() == 0
