"""Graphs, grammars and traces as files and text. Everything here is for one small result that a person or a tool reads."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import Graphs
from ..operators.parsing import Parsed
from ..operators.reports import grammar_stats, order_histogram, rule_stats
from ..operators.rules import Grammar


def graph_dict(graphs: Graphs, graph_id: str) -> dict:
    """The JSON form of one graph, sorted; rows come to the driver one partition at a time."""
    v = graphs.vertices.where(F.col("graph_id") == graph_id).orderBy("v").select("v", "x", "y")
    e = graphs.edges.where(F.col("graph_id") == graph_id).orderBy("u", "w").select("u", "w")
    return {"vertices": [{"id": r["v"], "x": r["x"], "y": r["y"]} for r in v.toLocalIterator()], "edges": [[r["u"], r["w"]] for r in e.toLocalIterator()]}


def _transform(t) -> dict:
    return {"linear": [[t["a00"], t["a01"]], [t["a10"], t["a11"]]], "translation": [t["b0"], t["b1"]]}


def grammar_dict(grammar: Grammar, graph_id: str) -> dict:
    """The JSON form of one graph's grammar. Absent symbols, node places and occurrences are left out; an absent axiom is null."""
    placed: dict = {}
    for p in grammar.placements.where(F.col("graph_id") == graph_id).orderBy("rule_id", "k").toLocalIterator():
        row = {"transform": _transform(p["transform"]), "vertices": [[v["local"], v["v"]] for v in p["vertices"]]}
        if p["node_x"] is not None:
            row["node"] = [p["node_x"], p["node_y"]]
        placed.setdefault(p["rule_id"], []).append(row)
    rules = []
    for r in grammar.rules.where(F.col("graph_id") == graph_id).orderBy("rule_id").toLocalIterator():
        points = [{"id": p["id"], "x": p["x"], "y": p["y"]} | ({"symbol": p["symbol"]} if p["symbol"] else {}) for p in r["rhs_vertices"]]
        row = {
            "id": r["rule_id"],
            "lhs": {"symbol": r["lhs"]},
            "level": r["level"],
            "frequency": r["frequency"],
            "rhs": {"vertices": points, "edges": [[e["u"], e["w"]] for e in r["rhs_edges"]]},
            "embedding": [{"vertex": e["vertex"], "transform": _transform(e["transform"]), "connections": [[c["x"], c["y"]] for c in e["connections"]]} for e in r["embedding"]],
        }
        if placed.get(r["rule_id"]):
            row["occurrences"] = placed[r["rule_id"]]
        rules.append(row)
    axiom = None if grammar.axiom is None else graph_dict(grammar.axiom, graph_id)
    return {"format": "ggg-2d", "version": 1, "dimension": 2, "transform_class": "similarity", "axiom": axiom, "rules": rules}


def save_json(data: dict, path: str) -> None:
    Path(path).write_text(json.dumps(data, indent=2), encoding="utf-8")


def grammar_text(grammar: Grammar, graph_id: str) -> str:
    """A listing of one graph's rules as a table: a line for each rule, then one for each of its vertices."""
    data = grammar_dict(grammar, graph_id)
    left = "none" if data["axiom"] is None else f"{len(data['axiom']['vertices'])}/{len(data['axiom']['edges'])}"
    out = [f"{len(data['rules'])} rules; vertices/edges that no rule replaces: {left}", "rule\tname\tlevel\tseen\tplaced\tvertices\tedges"]
    for r in data["rules"]:
        rhs = r["rhs"]
        out.append("\t".join(map(str, (r["id"], r["lhs"]["symbol"], r["level"], r["frequency"], len(r.get("occurrences", [])), len(rhs["vertices"]), len(rhs["edges"])))))
        outer = {e["vertex"]: e["connections"] for e in r["embedding"]}
        for p in rhs["vertices"]:
            near = sorted({a if b == p["id"] else b for a, b in rhs["edges"] if p["id"] in (a, b)})
            links = "".join(f" ({x:.4g} {y:.4g})" for x, y in outer.get(p["id"], []))
            out.append(f"\t{p['id']}{' = ' + p['symbol'] if p.get('symbol') else ''}\t({p['x']:.4g} {p['y']:.4g})\tnext to {near or '-'}\toutwards{links or ' -'}")
    return "\n".join(out)


def report(graphs: Graphs, occurrences: DataFrame, grammar: Grammar, graph_id: str) -> dict:
    """Sizes, shapes by order and the grammar's savings of one graph."""
    mine = F.col("graph_id") == graph_id
    stats = grammar_stats(graphs, grammar).where(mine).first().asDict()
    stats.pop("graph_id")
    rules = [r.asDict() for r in rule_stats(grammar).where(mine).orderBy("rule_id").drop("graph_id").collect()]
    orders = {r["ord"]: {"groups": r["groups"], "max_frequency": r["max_frequency"]} for r in order_histogram(occurrences).where(mine).orderBy("ord").collect()}
    return {"input": {"vertices": stats["input_vertices"], "edges": stats["input_edges"]}, "isogroups_by_order": orders, "grammar": stats | {"rules": rules}}


def trace(parsed: Parsed, graph_id: str) -> dict:
    """The derivation of one graph, a line for each step."""
    mine = F.col("graph_id") == graph_id
    s = parsed.summary().where(mine).first()
    steps = [r.asDict() for r in parsed.steps.where(mine).orderBy("step").drop("graph_id").collect()]
    for r in steps:
        r["occurrences"] = r.pop("n_occurrences")
    return {"input": {"vertices": s["input_vertices"], "edges": s["input_edges"]}, "reduced": {"vertices": s["reduced_vertices"], "edges": s["reduced_edges"]}, "steps": steps}


def trace_text(parsed: Parsed, graph_id: str) -> str:
    """The derivation of one graph as a table, and the sizes before and after."""
    data = trace(parsed, graph_id)
    out = ["step\trule\tlevel\torder\ttimes\tvertices"]
    out += ["\t".join(map(str, (r["step"], r["symbol"], r["level"], r["order"], r["occurrences"], f"{r['vertices_before']} to {r['vertices_after']}"))) for r in data["steps"]]
    size = lambda d: f"{d['vertices']} vertices and {d['edges']} edges"
    out.append(f"{size(data['input'])} became {size(data['reduced'])}" if data["steps"] else f"{size(data['input'])}: no rule occurs")
    return "\n".join(out)


def report_text(data: dict) -> str:
    """What report gives, as a table of orders and one of rules."""
    g = data["grammar"]
    out = [f"graph: {data['input']['vertices']} vertices, {data['input']['edges']} edges", "order\tshapes\tmost often"]
    out += [f"{order}\t{x['groups']}\t{x['max_frequency']}" for order, x in sorted(data["isogroups_by_order"].items())]
    out.append("rule\tlevel\torder\tseen\tplaced\tsaved")
    out += [f"{r['rule_id']}\t{r['level']}\t{r['ord']}\t{r['frequency']}\t{r['encoded']}\t{r['saved']}" for r in g["rules"]]
    out.append(f"{g['n_rules']} rules on {g['levels']} levels save {g['vertices_saved']} vertices ({g['compression_ratio']:.1%}); {g['axiom_vertices']} are left")
    return "\n".join(out)


def coloured_edges(graphs: Graphs, groups: DataFrame) -> DataFrame:
    """graph_id, u, w, colour: what a drawing needs. groups: (graph_id, v, colour); the highest colour of a vertex counts,
    and an edge has a colour only if both its ends have it."""
    last = groups.groupBy("graph_id", "v").agg(F.max("colour").alias("colour"))
    end = lambda c: last.select("graph_id", F.col("v").alias(c), F.col("colour").alias(f"{c}_colour"))
    both = graphs.edges.join(end("u"), ["graph_id", "u"], "left").join(end("w"), ["graph_id", "w"], "left")
    return both.select("graph_id", "u", "w", F.when(F.col("u_colour") == F.col("w_colour"), F.col("u_colour")).alias("colour"))
