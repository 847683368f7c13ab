"""DOT text of nets; pictures only where a dot program is installed."""

from __future__ import annotations

import shutil
import subprocess

from lodetrace.operators.nets import AcceptingNet, PetriNet


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def net_dot(model: PetriNet | AcceptingNet, styled: bool = False) -> str:
    """Places as circles, transitions as boxes, silent ones filled; styled marks initial and final places, weights and guards."""
    net = model.net if isinstance(model, AcceptingNet) else model
    names, lines = {}, []
    for k, p in enumerate(sorted(net.places, key=lambda p: (p.name, p.id))):
        names[p] = f"p{k}"
        look = ""
        if styled and isinstance(model, AcceptingNet):
            look = ', style=filled, fillcolor="palegreen"' if model.initial[p] else ', style=filled, fillcolor="lightcoral"' if any(m[p] for m in model.finals) else ""
        lines.append(f"  {names[p]} [shape=circle, label={_quoted(p.name)}{look}];")
    for k, t in enumerate(sorted(net.transitions, key=lambda t: (t.name, t.id))):
        names[t] = f"t{k}"
        label = t.name + (f"\n{t.weight:g}" if styled and t.weight != 1 else "") + (f"\n{t.guard.text}" if styled and t.guard.text != "true" else "")
        look = ", style=filled, fillcolor=black, fontcolor=white" if t.silent else ""
        lines.append(f"  {names[t]} [shape=box, label={_quoted(label)}{look}];")
    lines += [f"  {a} -> {b};" for a, b in sorted((names[x.source], names[x.target]) for x in net.arcs)]
    return f"digraph {_quoted(net.name)} {{\n  rankdir=LR;\n" + "\n".join(lines) + "\n}\n"


def write_image(dot: str, path: str, kind: str = "png") -> None:
    if shutil.which("dot") is None:
        raise RuntimeError("no dot program is installed")
    subprocess.run(["dot", f"-T{kind}", "-o", path], input=dot.encode(), check=True)
