"""The XES data source: byte ranges, many files, pruning, commit and abort."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from lodetrace.operators.log import DataLog, EventLog
from lodetrace.sources import xes, xes_format

DOC = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a log --><x:log xmlns:x="http://www.xes-standard.org/"><x:string key="concept:name" value="l"/>
<x:trace><x:string key="concept:name" value="one"/><x:event><x:string key="concept:name" value="a &amp; é"><x:int key="deep" value="3"/></x:string><x:boolean key="ok" value="1"/></x:event>
<x:event><x:string key="concept:name" value="b"/><x:string key="r" value="x"/><x:string key="r" value="y"/></x:event></x:trace>
<x:trace/><x:trace   ><x:event><x:string key="name" value="n"/><x:string key="concept:name" value="c"/></x:event></x:trace>
</x:log>"""


def rows_of(log):
    return {tuple(r["variant"]): r["freq"] for r in log.simplify().variants.collect()}


@pytest.mark.parametrize("split", [0, 100, 333, 1 << 20])
def test_byte_ranges_have_each_trace_once(spark, tmp_path, split):
    path = tmp_path / "d.xes"
    path.write_text(DOC, encoding="utf-8")
    log = xes_format.read_log(spark, str(path), split_bytes=split)
    assert rows_of(log) == {("a & é", "b"): 1, (): 1, ("c",): 1}
    first = log.events.where("activity <> 'c'").orderBy("pos").collect()
    assert {k: (v["type"], v["text"]) for k, v in first[0]["attrs"].items()} == {"deep": ("int", "3"), "ok": ("boolean", "true")}
    assert first[1]["attrs"]["r"]["text"] == "y"
    assert [r["attrs"]["concept:name"]["text"] for r in log.cases.where(F.size("attrs") > 0).collect()] == ["one"]
    assert rows_of(xes_format.read_log(spark, str(path), ["name", "concept:name"], attributes=False, split_bytes=split)) == {("a & é", "b"): 1, (): 1, ("n c",): 1}


def test_ranges_against_whole_documents():
    import io

    r = random.Random(4)
    for _ in range(40):
        traces = ["<trace>" + "".join(f'<event><string key="concept:name" value="{"é" * r.randint(0, 5)}{r.randint(0, 9)}"/></event>' for _ in range(r.randint(0, 4))) + "</trace>" for _ in range(r.randint(0, 6))]
        raw = ("<log>" + " ".join(traces) + "</log>").encode()
        whole = list(xes_format.range_rows(io.BytesIO(raw), len(raw), 0, None, ["concept:name"], True))
        step = r.randint(1, 60)
        cuts = [*range(0, len(raw), step)]
        parts = [x for a, b in zip(cuts, [*cuts[1:], None]) for x in xes_format.range_rows(io.BytesIO(raw), len(raw), a, b, ["concept:name"], True)]
        assert parts == whole and sum(x[1] is None for x in whole) == len(traces)


def test_round_trip_of_fifty_files(spark, tmp_path):
    """Written by tasks, read by ranges, none by the driver; a second write appends, an overwrite replaces."""
    r = random.Random(1)
    rows = [(c, p, r.choice("abc") + '<"&', {"k": (r.choice(["int", "string"]), str(p)), "n\n": ("string", "\té")}) for c in range(600) for p in range(r.randint(0, 4))]
    events = spark.createDataFrame(rows, f"case_id long, pos long, activity string, attrs {xes_format.ATTRS}")
    cases = spark.createDataFrame([(c, {"id": ("int", str(c))}) for c in range(600)], f"case_id long, attrs {xes_format.ATTRS}")
    folder = str(tmp_path / "logs")
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        xes_format.write_log(DataLog(events, cases, {"made": 5}, "fifty"), folder)
        files = glob.glob(folder + "/*.xes")
        assert len(files) == 50 and os.path.exists(folder + "/_SUCCESS") and not glob.glob(folder + "/_temp*")
        again = xes_format.read_log(spark, folder, split_bytes=3000)
        key = again.cases.select("case_id", F.col("attrs")["id"]["text"].cast("long").alias("c"))
        got = again.events.join(key, "case_id").select("c", "pos", "activity", F.to_json("attrs").alias("a"))
        want = events.select(F.col("case_id").alias("c"), "pos", "activity", F.to_json("attrs").alias("a"))
        assert again.cases.count() == 600 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        assert xes.log_attributes(spark, files[0]) == {"concept:name": "fifty", "made": 5}
        xes_format.write_log(EventLog.from_traces(spark, ["ab", "ab", "", "c"]), folder)
        assert xes_format.read_log(spark, folder, attributes=False).cases.count() == 604
        xes_format.write_log(EventLog.from_traces(spark, ["ab", "ab", "", "c"]), folder, mode="overwrite")
        assert rows_of(xes_format.read_log(spark, folder, attributes=False)) == {("a", "b"): 2, (): 1, ("c",): 1}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "logs")
    bad = spark.range(100).select(F.col("id").alias("trace"), F.lit(0).cast("long").alias("pos"), F.when(F.col("id") < 99, "a").otherwise(F.raise_error(F.lit("no"))).cast("string").alias("activity"))
    spark.dataSource.register(xes_format.XesSource)
    with pytest.raises(Exception, match="no"):
        bad.repartition(4).write.format("xes").mode("append").save("file://" + folder)
    assert not glob.glob(folder + "/*.xes") and not glob.glob(folder + "/_temp*")


def test_faults(spark, tmp_path):
    path = tmp_path / "d.xes"
    path.write_text(DOC, encoding="utf-8")
    with pytest.raises(Exception, match="none of the labels"):
        xes_format.read_log(spark, str(path), "spam").events.collect()
    with pytest.raises(Exception, match="FileNotFound|none.xes"):
        xes_format.read_log(spark, str(tmp_path / "none.xes")).events.collect()
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("xes").schema("spam string").load("file://" + str(path)).collect()
    (tmp_path / "empty").mkdir()
    assert xes_format.read_log(spark, str(tmp_path / "empty")).cases.count() == 0


def test_small_ranges_share_tasks(spark, tmp_path):
    raw = "<log>" + "".join(f'<trace><int key="n" value="{i}"/><event><string key="concept:name" value="a"/><int key="i" value="{i}"/></event></trace>' for i in range(3000)) + "</log>"
    (tmp_path / "a.xes").write_text(raw)
    (tmp_path / "b.xes").write_text("<log><trace/></log>")
    spark.dataSource.register(xes_format.XesSource)
    log = xes_format.read_log(spark, str(tmp_path), split_bytes=1024)
    assert log.events.rdd.getNumPartitions() <= 2 * xes_format.LEAST_TASKS
    value = lambda k: F.col("attrs")[k]["text"].cast("int")
    assert sorted(r[0] for r in log.events.where("pos = 0 AND activity = 'a'").select(value("i")).collect()) == list(range(3000))
    assert sorted(r[0] for r in log.cases.select(F.coalesce(value("n"), F.lit(-1))).collect()) == list(range(-1, 3000))
    joined = log.events.select("case_id", value("i").alias("i")).join(log.cases.select("case_id", value("n").alias("n")), "case_id")
    assert joined.where("i = n").count() == 3000


def test_a_range_reads_little_beyond_its_end():
    import io

    raw = ("<log>" + '<trace><event><string key="concept:name" value="a"/></event></trace>' * 30000 + "</log>").encode()
    source = io.BytesIO(raw)
    assert list(xes_format.range_rows(source, len(raw), 1 << 18, 1 << 19, ["concept:name"], True))
    assert source.tell() <= (1 << 19) + 2 * xes_format.TAIL
