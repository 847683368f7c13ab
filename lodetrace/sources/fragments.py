"""Nets from sketches such as ``I -> [a] -> p -> {b__2 5.0} -> F``.

    sketch  = node {"->" node}
    node    = place | "[" label ["__" id] "]" | "{" label ["__" id] [weight] "}"
    place   = label ["__" id]

A transition in braces has a weight, 1.0 if none is written; one labelled tau, with digits or not, is silent.
Nodes of one label and id are one node, across sketches too.
"""

from __future__ import annotations

import re

from lodetrace.operators.nets import AcceptingNet, Marking, NetBuilder, PetriNet

_NODE = re.compile(r"\s*(?:\[(?P<plain>[^\]]+)\]|\{(?P<weighted>[^}]+)\}|(?P<place>[A-Za-z0-9_][A-Za-z0-9_ ]*?))\s*(?P<arc>->|$)")
_SILENT = re.compile(r"tau[0-9]*")
_NUMBER = re.compile(r"\s+(\d+(?:\.\d+)?)$")


def _label(text: str) -> tuple[str, str | None]:
    name, _, ident = text.strip().partition("__")
    if not name.strip():
        raise ValueError(f"a node without a label in {text!r}")
    return name.strip(), ident.strip() or None


class FragmentParser:
    def __init__(self):
        self.builder, self._known = NetBuilder(), {}

    def create_net(self, title: str, text: str) -> PetriNet:
        self.builder, self._known = NetBuilder(title), {}
        return self.add_to_net(text)

    def add_to_net(self, text: str) -> PetriNet:
        at, before, open_arc = 0, None, False
        text = text.strip()
        if not text:
            raise ValueError("a sketch is empty")
        while at < len(text):
            m = _NODE.match(text, at)
            if not m:
                raise ValueError(f"can't read the sketch at {text[at:]!r}")
            node = self._node(m)
            if before is not None:
                self.builder.arc(before, node)
            before, at, open_arc = node, m.end(), m["arc"] == "->"
        if open_arc:
            raise ValueError("a sketch ends with an arc")
        return self.builder.build()

    def _node(self, m):
        if m["place"] is not None:
            name, ident = _label(m["place"])
            key = ("place", name, ident)
            return self._known.setdefault(key, None) or self._keep(key, self.builder.place(name, ident and f"p_{ident}"))
        text, weight = m["plain"], 1.0
        if m["weighted"] is not None:
            text = m["weighted"].strip()
            if w := _NUMBER.search(text):
                text, weight = text[: w.start()], float(w[1])
        name, ident = _label(text)
        key = ("transition", name, ident)
        known = self._known.get(key)
        return known or self._keep(key, self.builder.transition(name, ident and f"t_{ident}", bool(_SILENT.fullmatch(name)), weight))

    def _keep(self, key, node):
        self._known[key] = node
        return node


def create_net(title: str, text: str) -> PetriNet:
    return FragmentParser().create_net(title, text)


def parse_fragments(title: str, *fragments: str) -> PetriNet:
    if not fragments:
        raise ValueError("no sketches")
    parser = FragmentParser()
    net = parser.create_net(title, fragments[0])
    for f in fragments[1:]:
        net = parser.add_to_net(f)
    return net


def accepting(net: PetriNet, initial: str = "I", final: str = "F") -> AcceptingNet:
    """One token in the place named initial, then one in the place named final."""
    at = {p.name: p for p in net.places}
    return AcceptingNet(net, Marking([at[initial]]), (Marking([at[final]]),))
