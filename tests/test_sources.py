"""XES, PNML and streams."""

import datetime as dt
import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest

from lodetrace.functions.guards import Guard
from lodetrace.operators import nets
from lodetrace.operators.log import DataLog
from lodetrace.sources import fragments, pnml, traces, xes

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
  <string key="concept:name" value="small"/><int key="ver" value="3"/><float key="life" value="0.1234567891"/><boolean key="on" value="1"/>
  <trace><string key="concept:name" value="t1"/><int key="cost" value="7"/>
    <event><string key="concept:name" value="A"/><string key="name" value="x y"/><date key="time:timestamp" value="2020-01-02T03:04:05+01:00"/><int key="res" value="5"/></event>
    <event><string key="concept:name" value="B"/><string key="name" value="z"/><boolean key="ok" value="False"/></event>
  </trace>
  <trace><string key="concept:name" value="t2"/></trace>
  <trace><event><string key="concept:name" value="A"/><string key="name" value="x y"/></event></trace>
</log>
"""


@pytest.fixture
def small(tmp_path):
    p = tmp_path / "small.xes"
    p.write_text(XES)
    return str(p)


def test_read_simple(spark, small, tmp_path):
    log = xes.read_simple(spark, small)
    assert log.name == "small" and log.text() == "[<>^1,<A,B>^1,<A>^1]"
    assert xes.read_simple(spark, small, "name").text() == "[<>^1,<x y,z>^1,<x y>^1]"
    assert xes.read_simple(spark, small, ["concept:name", "name"]).contains(["A x y", "B z"])
    with pytest.raises(FileNotFoundError):
        xes.read_simple(spark, str(tmp_path / "none.xes"))
    with pytest.raises(Exception, match="none of the labels"):
        xes.read_simple(spark, small, "spam").text()


def test_read_complex_and_round_trip(spark, small, tmp_path):
    log = xes.read_complex(spark, small)
    assert log.attributes == {"concept:name": "small", "ver": 3, "life": 0.12345679, "on": True}
    first = log.events.where("activity = 'A' AND size(attrs) > 1").first()["attrs"]
    assert xes._typed(first) == {"name": "x y", "time:timestamp": dt.datetime.fromisoformat("2020-01-02T03:04:05+01:00"), "res": 5}
    out = str(tmp_path / "deep" / "out.xes")
    xes.write_complex(out, log)
    again = xes.read_complex(spark, out)
    assert again.equals(log) and again.attributes == log.attributes
    cols = xes.promoted(log, ["res", "ok"]).events
    assert dict(cols.dtypes)["res"] == "bigint" and dict(cols.dtypes)["ok"] == "boolean"
    with pytest.raises(ValueError):
        xes.write_complex(out, "no log")


def test_write_simple(spark, tmp_path):
    log = traces.convert(spark, "a <b>", "a <b>", "", name='n "q"')
    out = str(tmp_path / "o.xes")
    xes.write_simple(out, log)
    again = xes.read_simple(spark, out)
    assert again.equals(log) and again.name == log.name
    assert len([t for t in ET.parse(out).getroot() if t.tag.endswith("trace")]) == 3


def test_values():
    assert xes.python_value("boolean", "TRUE") is True and xes.python_value("boolean", "maybe") == "maybe"
    assert xes.attribute_tag(True) == ("boolean", "true") and xes.attribute_tag(2) == ("int", "2") and xes.attribute_tag(1.5)[0] == "float"
    assert xes.value_type("{ns}date") == "date" and xes.value_type("list") == "string"


def test_pnml_round_trip(tmp_path):
    b = nets.NetBuilder("n")
    i, f = b.place("I"), b.place("F")
    t, s = b.transition("A", weight=2.5, guard=Guard("d1 < 5")), b.silent()
    b.arc(i, t).arc(t, f).arc(i, s).arc(s, f)
    model = nets.AcceptingNet(b.build(), nets.Marking([i]), (nets.Marking([f]),))
    path = str(tmp_path / "x" / "n.pnml")
    pnml.write_pnml(model, path)
    back = pnml.read_pnml(path, weights=True, guards=True)
    assert isinstance(back, nets.AcceptingNet) and back.net.same_structure(model.net)
    assert [p.name for p in back.initial] == ["I"] and [p.name for p in back.finals[0]] == ["F"]
    assert pnml.net_xml(model) == pnml.net_xml(model) and "java.lang.Double" in pnml.net_xml(model)
    assert all(len(p.id) == 36 for p in pnml.read_pnml(path, local_ids=True).net.places)
    plain = str(tmp_path / "p.pnml")
    pnml.write_pnml(fragments.create_net("q", "I -> [a] -> F"), plain, prom=False)
    assert isinstance(pnml.read_pnml(plain), nets.PetriNet) and "toolspecific" not in open(plain).read()


def test_stream_pairs(spark, tmp_path):
    from lodetrace.streaming.pairs import stream_pairs

    base = dt.datetime(2024, 1, 1)
    at = lambda m: base + dt.timedelta(minutes=m)
    schema = "c string, a string, ts timestamp"
    src = str(tmp_path / "in")
    batches = [[("x", "b", at(5)), ("x", "a", at(0)), ("y", "a", at(3))], [("x", "c", at(8)), ("z", "late", at(60))], [("z", "later", at(200))]]
    for rows in batches[:1]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_pairs(stream, "c", "a", "ts").writeStream.outputMode("append").format("memory").queryName("pairs_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        for rows in batches[1:]:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("pairs_out").collect())
    finally:
        q.stop()
    assert got == [("x", "SOURCE", "a"), ("x", "a", "b"), ("x", "b", "c"), ("y", "SOURCE", "a"), ("z", "SOURCE", "late")]


def test_traces_are_parsed_as_they_are_read():
    lines = ["<trace>", *['<event><string key="concept:name" value="a"/></event>'] * 5000, "</trace>"] * 2
    read = []

    def batches():
        for line in lines:
            read.append(line)
            yield pa.RecordBatch.from_arrays([pa.array([line])], ["value"])

    out = xes.parsed_batches(batches(), whole=True)
    first = next(out)
    assert first.num_rows == xes.ROWS and len(read) <= xes.ROWS + 1
    rest = [first, *out]
    assert sum(b.num_rows for b in rest) == 10002 and max(b.num_rows for b in rest) == xes.ROWS
    assert [r for b in rest for r in zip(*b.select(["case_id", "pos"]).to_pydict().values())] == [(c, p) for c in (0, 1) for p in [*range(5000), None]]


def test_texts_of_traces_are_rows_of_events(spark):
    events = spark.createDataFrame([(None, 1, "b"), (None, 0, "a"), (1, 0, "<c>"), (7, 0, "other")], "case_id long, pos int, activity string")
    log = DataLog(events, spark.createDataFrame([(None,), (1,), (2,)], "case_id long"))
    texts = xes.trace_texts(log)
    assert max(r["value"].count("<event>") for r in texts.collect()) == 1
    rows = xes._events(xes.parsed_traces(texts, whole=True), [xes.LABEL]).select("case_id", "pos", "activity").collect()
    assert sorted((r["pos"], r["activity"]) for r in rows) == [(0, "<c>"), (0, "a"), (1, "b")]
    assert xes.parsed_traces(texts, whole=True).where("pos IS NULL").count() == 3
