"""Sinks of the symbol report: a document of one symbol's facts, and its text, Graphviz and HTML views."""

from __future__ import annotations

import html
import json

from pyspark.sql import functions as F

from ..operators.rollups import HOTSPOTS, hotspots, per_file, roll_up
from ..operators.symbol import Walk, symbol_facts
from .module_report import percent

TREE_LINES, GRAPH_CROSSINGS, ROWS = 80, 60, 20  # fixed values


def pad(text: object, width: int) -> str:
    return f"{text!s:<{width}}"


def symbol_document(symbol, w: Walk, matches, lines, calls, boundary: dict | None = None, edges=None) -> dict:
    """Everything about one symbol of a walk; the walk's size is bounded by its limits."""
    mine = lambda df: df.where(F.col("symbol") == symbol)
    facts = mine(symbol_facts(w, matches, lines)).first()
    nodes = mine(w.nodes)
    ids = nodes.select(F.col("fn_id").alias("from_fn"))
    inside = calls.join(ids, "from_fn", "left_semi").join(ids.select(F.col("from_fn").alias("to_fn")), "to_fn", "left_semi").select("from_fn", "to_fn").distinct()
    take = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    crossings = mine(w.crossings)
    return {
        "symbol": symbol,
        "facts": facts.asDict(recursive=True) if facts else None,
        "boundary": boundary or {},
        "nodes": take(nodes.select("fn_id", "name", "file", "start", "own", "inline", "depth").orderBy("depth", "fn_id")),
        "edges": take(inside.orderBy("from_fn", "to_fn")),
        "hotspots": take(hotspots(nodes.select("fn_id", "name", "file", "start", "depth", "own", "inline"), HOTSPOTS)),
        "perFile": take(per_file(nodes).orderBy(F.desc("complexity"), "file")),
        "modules": take(roll_up(crossings.where("module is not null"), ["module"]).orderBy((F.col("calls") + F.col("references")).desc(), "module")),
        "crossings": take(crossings.orderBy("file", "name")),
        "stops": take(mine(w.stops).groupBy("reason").count().orderBy(F.desc("count"), "reason")),
        "edgesCompared": take(mine(edges).orderBy("reach", "edge")) if edges is not None else [],
    }


def call_tree(document: dict, limit: int = TREE_LINES) -> list[tuple[int, dict, bool]]:
    """(depth, node, seen before) in the order of a depth-first walk from the seeds; a repeated node is not opened again."""
    by_id = {n["fn_id"]: n for n in document["nodes"]}
    below: dict = {}
    for e in document["edges"]:
        below.setdefault(e["from_fn"], []).append(e["to_fn"])
    out, seen = [], set()
    todo = [(0, n["fn_id"]) for n in reversed(document["nodes"]) if n["depth"] == 0]
    while todo and len(out) < limit:
        depth, at = todo.pop()
        out.append((depth, by_id[at], at in seen))
        if at not in seen:
            seen.add(at)
            todo += [(depth + 1, x) for x in reversed(below.get(at, []))]
    return out


def symbol_json(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False, default=str)


def symbol_text(document: dict, rows: int = ROWS, brief: bool = False) -> str:
    f = document["facts"]
    out = [f"symbol  {document['symbol']}"]
    if f is None:
        return out[0] + "\n  no function was reached"
    for k, v in document["boundary"].items():
        out.append(f"  {pad(k, 24)}{v}")
    out += ["", "complexity", f"  own {f['own']}   with callbacks {f['own_plus_inline']}   transitive {f['transitive']}" + ("   floor" if f["floor"] else ""), f"  functions {f['reach']}   depth {f['depth']}"]
    out += [f"  {pad(h['name'], 44)}{pad(h['own'] + h['inline'], 7)}{h['file']}:{h['start']}" for h in document["hotspots"][:rows]]
    out += ["", "dependencies", *[f"  {pad(m['module'], 52)}{pad(f'{m["calls"]} calls', 11)}{pad(f'{m["references"]} refs', 10)}{', '.join(m['names'][:5])}" for m in document["modules"][:rows]]]
    out += ["", f"effects  {', '.join(f['effects']) or 'none'}", f"coverage {percent(f['coverage'])}  {f['covered'] or 0}/{f['known'] or 0} known lines"]
    out += [f"confidence {f['confidence']:.2f}  " + ", ".join(f"{s['reason']}={s['count']}" for s in document["stops"])]
    if not brief:
        out += ["", "call tree", *["  " + "   " * d + f"{n['name']}  +{n['own'] + n['inline']}  {n['file']}:{n['start']}" + ("  (seen)" if seen else "") for d, n, seen in call_tree(document)]]
    if document["edgesCompared"]:
        out += ["", "edges", *[f"  {pad(e['edge'], 10)}{pad(e['reach'], 8)}{pad(e['transitive'], 8)}{pad(e['stops'], 8)}{pad(e['crossings'], 11)}{e['modules']}" for e in document["edgesCompared"]]]
    return "\n".join(out)


def symbol_dot(document: dict) -> str:
    name = lambda x: '"' + str(x).replace('"', "'") + '"'
    out = ["digraph calls {", "  rankdir=LR;"]
    out += [f"  {name(n['fn_id'])} [label={name(n['name'])}];" for n in document["nodes"]]
    out += [f"  {name(a)} -> {name(b)};" for a, b in dict.fromkeys((e["from_fn"], e["to_fn"]) for e in document["edges"])]
    root = next((n["fn_id"] for n in document["nodes"] if n["depth"] == 0), None)
    out += [f"  {name(root)} -> {name(c['name'])} [style=dashed];" for c in document["crossings"][:GRAPH_CROSSINGS] if root is not None]
    return "\n".join([*out, "}"])


def symbol_html(document: dict) -> str:
    """One page without other files; the data block cannot end its script."""
    data = json.dumps(document, ensure_ascii=False, default=str).replace("<", "\\u003c")
    keys = ("boundary", "facts", "hotspots", "perFile", "modules", "crossings", "stops", "edgesCompared", "nodes")
    panels = "".join(f"<section><h2>{html.escape(k)}</h2><pre id='{k}'></pre></section>" for k in keys)
    script = "const d=JSON.parse(document.getElementById('data').textContent);const show=()=>{const q=document.getElementById('q').value.toLowerCase();for(const p of document.querySelectorAll('pre')){const v=d[p.id];const rows=Array.isArray(v)?v:[v];p.textContent=rows.map(x=>JSON.stringify(x)).filter(x=>!q||x&&x.toLowerCase().includes(q)).join('\\n')}};document.getElementById('q').oninput=show;show()"
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(str(document['symbol']))}</title><h1>{html.escape(str(document['symbol']))}</h1><input id='q' placeholder='filter'>{panels}<script type='application/json' id='data'>{data}</script><script>{script}</script>"
