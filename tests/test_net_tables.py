"""Nets as tables through PNML documents, against the reader and writer of one net."""

from lodetrace.functions.guards import Guard
from lodetrace.operators.nets import AcceptingNet, Arc, Marking, PetriNet, Place, Transition
from lodetrace.sources import net_tables, pnml

ODD = 'a < b & "c"\n>'
P = "net_id string, pid string, name string, initial int, final int"
T = "net_id string, tid string, name string, silent boolean, weight double, guard string"
A = "net_id string, source string, target string"


def _given(spark):
    places = [("n1", "p1", "in", 1, 0), ("n1", "p2", ODD, 0, 2), ("n 2", "p1", "only", 0, 0), ("n1", None, "none", 1, 1)]
    transitions = [("n1", "t1", ODD, False, 2.5, "k < 4 && m > 3"), ("n1", "t2", None, True, 1.0, "true"), ("n 2", "t1", "\x01x", None, None, None)]
    arcs = [("n1", "p1", "t1"), ("n1", "t1", "p2"), ("n1", "p1", "t2"), ("n1", "t2", "p2"), ("n1", None, "t1"), ("lost", "a", "b")]
    return spark.createDataFrame(places, P), spark.createDataFrame(transitions, T), spark.createDataFrame(arcs, A)


def _rows(tables):
    return {k: sorted(map(tuple, v.collect())) for k, v in tables.items()}


def test_round_trip_through_files_and_texts(spark, tmp_path):
    given = _given(spark)
    want = {
        "places": [("n 2", "p1", "only", 0, 0), ("n1", "p1", "in", 1, 0), ("n1", "p2", ODD, 0, 2)],
        "transitions": [("n 2", "t1", "�x", False, 1.0, "true"), ("n1", "t1", ODD, False, 2.5, "k < 4 && m > 3"), ("n1", "t2", "t2", True, 1.0, "true")],
        "arcs": sorted([("n1", "p1", "t1"), ("n1", "t1", "p2"), ("n1", "p1", "t2"), ("n1", "t2", "p2")]),
    }
    net_tables.write_nets(str(tmp_path / "nets"), *given)
    assert _rows(net_tables.read_nets(spark, str(tmp_path / "nets"))) == want
    assert _rows(net_tables.nets_of(net_tables.pnml_documents(*given))) == want
    odd = spark.createDataFrame([("x", "no xml <"), ("y", None), ("z", "<pnml><net id='z'/></pnml>")], "net_id string, pnml string")
    assert _rows(net_tables.nets_of(odd)) == {"places": [], "transitions": [], "arcs": []}
    none = [t.limit(0) for t in given]
    assert net_tables.pnml_documents(*none).count() == 0


def test_documents_are_read_as_single_nets(spark, tmp_path):
    text = net_tables.pnml_documents(*_given(spark)).where("net_id = 'n1'").first()["pnml"]
    (tmp_path / "one.pnml").write_text(text, encoding="utf-8")
    got = pnml.read_pnml(str(tmp_path / "one.pnml"), weights=True, guards=True)
    assert isinstance(got, AcceptingNet) and sorted(t.weight for t in got.net.transitions) == [1.0, 2.5]
    assert {t.guard.text for t in got.net.transitions} == {"true", "k < 4 && m > 3"} and {t.silent for t in got.net.transitions} == {True, False}
    assert len(got.net.arcs) == 4 and [got.initial[p] for p in got.net.places if p.name == "in"] == [1]


def test_single_nets_are_read_as_documents(spark, tmp_path):
    a, b, t = Place("a", "1"), Place("b", "2"), Transition("go", "3", False, 3.0, Guard("k >= 2"))
    net = AcceptingNet(PetriNet([a, b], [t], [Arc(a, t), Arc(t, b)], "n"), Marking({a: 1}), (Marking({b: 1}),))
    for k in range(3):
        pnml.write_pnml(net, str(tmp_path / "many" / f"{k}.pnml"))
    lists = "<pnml><net id='own'><place id='p'/><transition id='t'><toolspecific tool='StochasticPetriNet'><property key='weight'>4</property></toolspecific></transition><arc source='p' target='t'/>"
    lists += "<initialmarkings><marking><place idref='p'><text>2</text></place></marking></initialmarkings><finalmarkings><marking><place idref='p'><text>1</text></place></marking></finalmarkings></net></pnml>"
    (tmp_path / "many" / "own.pnml").write_text(lists)
    got = _rows(net_tables.read_nets(spark, str(tmp_path / "many")))
    assert got["places"] == [("net1", "p1", "a", 1, 0)] * 3 + [("net1", "p2", "b", 0, 1)] * 3 + [("own", "p", "p", 2, 1)]
    assert got["transitions"] == [("net1", "t1", "go", False, 3.0, "k >= 2")] * 3 + [("own", "t", "t", False, 4.0, "true")]
    assert len(got["arcs"]) == 7
