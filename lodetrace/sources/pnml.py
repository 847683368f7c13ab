"""PNML nets: reading plain, weighted and guarded nets, and writing. Nets have the size of a model and are read on the driver."""

from __future__ import annotations

import os
import uuid
import xml.etree.ElementTree as ET

from lodetrace.functions.guards import Guard
from lodetrace.operators.nets import AcceptingNet, Arc, Marking, PetriNet, Place, Transition

WEIGHT_TOOL = "StochasticPetriNet"
PROM_TOOL = "ProM"


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def _child(node, name: str):
    return next((c for c in node if _bare(c.tag) == name), None)


def _children(node, name: str):
    return [c for c in node if _bare(c.tag) == name]


def _text(node, name: str, default: str = "") -> str:
    inner = _child(node, name)
    t = _child(inner, "text") if inner is not None else None
    return (t.text or "").strip() if t is not None else default


def _marking(node, places: dict) -> Marking:
    tokens = {}
    for m in _children(node, "marking"):
        for p in _children(m, "place"):
            n = int((_child(p, "text").text or "0").strip()) if _child(p, "text") is not None else 0
            tokens[places[p.get("idref")]] = n
    return Marking(tokens)


def read_pnml(path: str, weights: bool = False, guards: bool = False, local_ids: bool = False) -> PetriNet | AcceptingNet:
    """The first page's net; an accepting net if it has an initial and a final marking.

    Weights stand as an attribute of the tool's element, or as a property in it; final markings in the places, or as a list in the net.
    """
    net = _child(ET.parse(path).getroot(), "net")
    page = _child(net, "page")
    page = net if page is None else page
    places, transitions = {}, {}

    def own_id(node):
        if local_ids:
            for t in _children(node, "toolspecific"):
                if t.get("localNodeID"):
                    return t.get("localNodeID")
        return node.get("id")

    initial, final_tokens = {}, {}
    for p in _children(page, "place"):
        places[p.get("id")] = made = Place(_text(p, "name", p.get("id")), own_id(p))
        tokens = _text(p, "initialMarking")
        if tokens:
            initial[made] = int(tokens)
        tokens = _text(p, "finalMarking")
        if tokens:
            final_tokens[made] = int(tokens)
    for t in _children(page, "transition"):
        tools = _children(t, "toolspecific")
        silent = any((s.get("activity") or "") == "$invisible$" for s in tools) or (t.get("invisible") or "").lower() == "true"
        weight = 1.0
        if weights:
            for s in tools:
                if s.get("tool") == WEIGHT_TOOL:
                    weight = float(s.get("weight") or weight)
                    for prop in _children(s, "property"):
                        if prop.get("key") == "weight":
                            weight = float(prop.text)
        transitions[t.get("id")] = Transition(_text(t, "name", t.get("id")), own_id(t), silent, weight, Guard(t.get("guard") or "true") if guards else Guard())
    node = lambda i: places.get(i) or transitions[i]
    arcs = [Arc(node(a.get("source")), node(a.get("target"))) for a in _children(page, "arc")]
    made = PetriNet(places.values(), transitions.values(), arcs, _text(net, "name", "net"))
    begin = Marking(initial)
    for holder in (net, page):
        if (start := _child(holder, "initialmarkings")) is not None and not len(begin):
            begin = _marking(start, places)
    ends = [m] if len(m := Marking(final_tokens)) else []
    for holder in (net, page) if page is not net else (net,):
        if (final := _child(holder, "finalmarkings")) is not None:
            ends += [m for m in (_marking(_single(x), places) for x in _children(final, "marking")) if len(m)]
    return AcceptingNet(made, begin, tuple(ends)) if len(begin) and ends else made


def _single(marking):
    holder = ET.Element("holder")
    holder.append(marking)
    return holder


def net_xml(model: PetriNet | AcceptingNet, prom: bool = True) -> str:
    """PNML text. Local ids are made from the kinds and names of nodes, only the first final marking is written, and a guard's variables are written as java.lang.Double."""
    net = model.net if isinstance(model, AcceptingNet) else model
    final = model.finals[0] if isinstance(model, AcceptingNet) and model.finals else Marking()
    root = ET.Element("pnml")
    out = ET.SubElement(root, "net", id="net1", type="http://www.pnml.org/version-2009/grammar/pnmlcoremodel")
    ET.SubElement(ET.SubElement(out, "name"), "text").text = net.name
    page = ET.SubElement(out, "page", id="n0")
    ids = {}

    def named(kind, node, k):
        ids[node] = f"{kind[0]}{k}"
        e = ET.SubElement(page, kind, id=ids[node])
        ET.SubElement(ET.SubElement(e, "name"), "text").text = node.name
        if prom:
            tool = {"tool": PROM_TOOL, "version": "6.4", "localNodeID": str(uuid.uuid5(uuid.NAMESPACE_OID, f"{ids[node]} {node.name}"))}
            if isinstance(node, Transition) and node.silent:
                tool["activity"] = "$invisible$"
            ET.SubElement(e, "toolspecific", tool)
        return e

    initial = model.initial if isinstance(model, AcceptingNet) else Marking()
    for k, p in enumerate(sorted(net.places, key=lambda p: (p.name, p.id)), 1):
        e = named("place", p, k)
        if initial[p]:
            ET.SubElement(ET.SubElement(e, "initialMarking"), "text").text = str(initial[p])
        if final[p]:
            ET.SubElement(ET.SubElement(e, "finalMarking"), "text").text = str(final[p])
    for k, t in enumerate(sorted(net.transitions, key=lambda t: (t.name, t.id)), 1):
        e = named("transition", t, k)
        if t.silent:
            e.set("invisible", "true")
        if t.guard.text != "true":
            e.set("guard", t.guard.text)
        if t.weight != 1.0:
            ET.SubElement(e, "toolspecific", tool=WEIGHT_TOOL, version="0.2", invisible=str(t.silent), priority="1", weight=str(t.weight), distributionType="IMMEDIATE")
    for k, a in enumerate(sorted(net.arcs, key=lambda a: (ids[a.source], ids[a.target])), 1):
        ET.SubElement(page, "arc", id=f"a{k}", source=ids[a.source], target=ids[a.target])
    names = sorted(set().union(*(t.guard.variables() for t in net.transitions), set()))
    if names:
        holder = ET.SubElement(out, "variables")
        for n in names:
            v = ET.SubElement(holder, "variable", type="java.lang.Double")
            ET.SubElement(v, "name").text = n
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"


def write_pnml(model: PetriNet | AcceptingNet, path: str, prom: bool = True) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(net_xml(model, prom))
