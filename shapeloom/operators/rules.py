"""Rules from mined shapes: covers of disjoint occurrences, the best rule, its encoding, and the learning loop."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import cover
from ..sources.scratch import stash
from .graphs import Graphs
from .mining import Local, Settings, detect, groups_of, in_context

T = "struct<a00:double,a01:double,a10:double,a11:double,b0:double,b1:double>"
RULE = (
    "graph_id string, rule_id int, lhs string, level int, frequency long, "
    "rhs_vertices array<struct<id:int,x:double,y:double,symbol:string>>, rhs_edges array<struct<u:int,w:int>>, "
    f"embedding array<struct<vertex:int,transform:{T},connections:array<struct<x:double,y:double>>>>"
)
PLACEMENT = f"graph_id string, rule_id int, k int, transform {T}, vertices array<struct<local:int,v:long>>, node_x double, node_y double"


@dataclass(frozen=True)
class Grammar:
    """rules (a row each), their placements in the world, and what is left of the graphs; axiom may be None."""

    rules: DataFrame
    placements: DataFrame
    axiom: Graphs | None


def similarity_row(matrix: np.ndarray, shift: np.ndarray) -> dict:
    return {"a00": float(matrix[0, 0]), "a01": float(matrix[0, 1]), "a10": float(matrix[1, 0]), "a11": float(matrix[1, 1]), "b0": float(shift[0]), "b1": float(shift[1])}


def covers(occurrences: DataFrame) -> DataFrame:
    """graph_id, grp, pos: for each group its disjoint cover (see kernels.cover). Groups run in parallel, each in one task."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("pos")
        return df.iloc[cover([frozenset(o) for o in df["occ"]])][["graph_id", "grp", "pos"]]

    return occurrences.select("graph_id", "grp", "pos", "occ").groupBy("graph_id", "grp").applyInPandas(run, "graph_id string, grp long, pos long")


def overlap_pairs(occurrences: DataFrame) -> DataFrame:
    """graph_id, grp, a, b: positions a < b of occurrences of one group that share a vertex; an equi-join on the vertices."""
    flat = occurrences.select("graph_id", "grp", "pos", F.explode("occ").alias("v"))
    left, right = flat.withColumnRenamed("pos", "a"), flat.withColumnRenamed("pos", "b")
    return left.join(right, ["graph_id", "grp", "v"]).where("a < b").select("graph_id", "grp", "a", "b").distinct()


def select_group(groups: DataFrame, score: Column | None = None, min_order: int = 2) -> DataFrame:
    """The group of each graph with the highest score (default: order, then frequency), then the larger key, that repeats."""
    score = F.struct("ord", "frequency") if score is None else score
    fit = groups.where((F.col("ord") >= min_order) & (F.col("frequency") >= 2))
    best = fit.groupBy("graph_id").agg(F.max_by(F.struct("ord", "key", "grp", "frequency"), F.struct(score.alias("s"), F.col("key"))).alias("best"))
    return best.select("graph_id", "best.*")


def best_rules(occurrences: DataFrame, min_cover: int = 2, prefer: str = "gain", min_order: int = 2) -> DataFrame:
    """graph_id, grp, k, pos, occ, frequency: the cover of each graph's best group, in order.

    gain: most vertices saved, then the larger order, then the larger key. dense: first the most edges for each vertex.
    """
    if prefer not in ("gain", "dense"):
        raise ValueError(f"no such preference: {prefer!r}")
    groups = groups_of(occurrences).where((F.col("ord") >= min_order) & (F.col("frequency") >= min_cover))
    fit = occurrences.join(groups.select("graph_id", "grp", "frequency"), ["graph_id", "grp"])
    chosen = stash(covers(fit).join(fit, ["graph_id", "grp", "pos"]), "rule-covers")
    saved = (F.col("ord") - 1) * F.col("n")
    rank = F.struct(saved.alias("saved"), "ord", "key")
    if prefer == "dense":
        rank = F.struct(F.round(F.col("n_edges") / F.col("ord"), 6).alias("density"), saved.alias("saved"), "ord", "key")
    sums = chosen.groupBy("graph_id", "grp", "ord", "key").agg(F.count("*").alias("n"), F.min_by("n_edges", "pos").alias("n_edges")).where(F.col("n") >= min_cover)
    winner = sums.groupBy("graph_id").agg(F.max_by("grp", rank).alias("grp"))
    k = F.row_number().over(Window.partitionBy("graph_id").orderBy("pos")) - 1
    return stash(chosen.join(winner, ["graph_id", "grp"]).select("graph_id", "grp", k.alias("k"), "pos", "occ", "frequency"), "rule-best")


def node_places(cover_rows: DataFrame, graphs: Graphs, placement: str) -> DataFrame:
    """graph_id, pos, node_x, node_y: the centroid of an occurrence, or its vertex of the highest degree (the lowest id of equals)."""
    if placement not in ("existing", "centroid"):
        raise ValueError(f"no such placement: {placement!r}")
    flat = cover_rows.select("graph_id", "pos", F.explode("occ").alias("v")).join(graphs.vertices, ["graph_id", "v"])
    if placement == "centroid":
        return flat.groupBy("graph_id", "pos").agg(F.avg("x").alias("node_x"), F.avg("y").alias("node_y"))
    best = flat.join(graphs.degrees(), ["graph_id", "v"]).groupBy("graph_id", "pos").agg(F.max_by(F.struct("x", "y"), F.struct("degree", -F.col("v"))).alias("p"))
    return best.select("graph_id", "pos", F.col("p.x").alias("node_x"), F.col("p.y").alias("node_y"))


def _vertex_frame(points: np.ndarray, near: list[int], i: int) -> tuple[np.ndarray, np.ndarray]:
    """Origin at point i, the x axis towards its first neighbour, lengths as they are."""
    angle = 0.0
    if near:
        d = points[near[0]] - points[i]
        angle = float(np.arctan2(d[1], d[0]))
    c, s = np.cos(-angle), np.sin(-angle)
    matrix = np.array([[c, -s], [s, c]])
    return matrix, matrix @ -points[i]


def _headers(quant: float, rule_id: int, level: int):
    def run(frames):
        for df in frames:
            rows = []
            for r in df.itertuples(index=False):
                here = Local(r.context)
                form = here.form(quant)
                place = {v: i for i, v in enumerate(form.order)}
                points = np.array([here.place[v] for v in form.order]) @ form.matrix.T + form.shift
                edges = sorted((min(place[u], place[w]), max(place[u], place[w])) for u, w in here.edges)
                near = {i: sorted({a if b == i else b for a, b in edges if i in (a, b)}) for i in range(len(points))}
                embedding = []
                for i, v in enumerate(form.order):
                    matrix, shift = _vertex_frame(points, near[i], i)
                    outer = [np.array(here.outside[n]) for n in here.around[v] if n in here.outside]
                    seen = [matrix @ (form.matrix @ p + form.shift) + shift for p in outer]
                    embedding.append({"vertex": i, "transform": similarity_row(matrix, shift), "connections": [{"x": float(p[0]), "y": float(p[1])} for p in seen]})
                vertices = [{"id": i, "x": float(p[0]), "y": float(p[1]), "symbol": None} for i, p in enumerate(points)]
                rows.append((r.graph_id, rule_id, f"R{rule_id}", level, r.frequency, vertices, [{"u": u, "w": w} for u, w in edges], embedding))
            yield pd.DataFrame(rows, columns=["graph_id", "rule_id", "lhs", "level", "frequency", "rhs_vertices", "rhs_edges", "embedding"])

    return run


def _placements(quant: float, rule_id: int):
    def run(frames):
        for df in frames:
            rows = []
            for r in df.itertuples(index=False):
                form = Local(r.context).form(quant)
                back = np.linalg.inv(form.matrix)
                vertices = [{"local": i, "v": v} for i, v in enumerate(form.order)]
                rows.append((r.graph_id, rule_id, r.k, similarity_row(back, -back @ form.shift), vertices, r.node_x, r.node_y))
            yield pd.DataFrame(rows, columns=["graph_id", "rule_id", "k", "transform", "vertices", "node_x", "node_y"])

    return run


def encode(graphs: Graphs, best: DataFrame, rule_id: int = 0, level: int = 0, placement: str = "existing", quant: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Rule rows and placement rows of one best group for each graph. The template comes from the cover's first occurrence."""
    context = in_context(best, graphs, "k", "frequency")
    rules = context.where("k = 0").select("graph_id", "frequency", "context").mapInPandas(_headers(quant, rule_id, level), RULE)
    placed = context.join(node_places(best, graphs, placement), ["graph_id", "pos"]).select("graph_id", "k", "context", "node_x", "node_y")
    return rules, placed.mapInPandas(_placements(quant, rule_id), PLACEMENT)


def rewrite(graphs: Graphs, best: DataFrame, places: DataFrame) -> Graphs:
    """Contract each covered occurrence to one node at its place (graph_id, k, node_x, node_y).

    The first node's id is one more than the largest id outside the first occurrence, and later ones go up by one: what
    replacing one after another gives, as ids that an occurrence leaves free are used again.
    """
    flat = best.select("graph_id", "k", F.explode("occ").alias("v"))
    first = flat.where("k = 0").select("graph_id", "v")
    ids = graphs.vertices.join(best.select("graph_id").distinct(), "graph_id", "left_semi")
    base = ids.join(first, ["graph_id", "v"], "left_anti").groupBy("graph_id").agg(F.max("v").alias("top"))
    base = best.select("graph_id").distinct().join(base, "graph_id", "left").select("graph_id", (F.coalesce("top", F.lit(-1)) + 1).alias("base"))
    mapping = flat.join(base, "graph_id").select("graph_id", "v", (F.col("base") + F.col("k")).alias("node"))
    nodes = places.join(base, "graph_id").select("graph_id", (F.col("base") + F.col("k")).alias("v"), F.col("node_x").alias("x"), F.col("node_y").alias("y"))
    return graphs.contract(mapping, nodes)


def learn(graphs: Graphs, settings: Settings | None = None, max_levels: int = 16, min_order: int = 2, placement: str = "existing", prefer: str = "gain") -> Grammar:
    """Encode the best rule of each graph, contract its cover, and go on until no graph repeats anything."""
    settings, spark = settings or Settings(), graphs.vertices.sparkSession
    rules = placements = None
    current = Graphs(stash(graphs.vertices, "learn-vertices"), stash(graphs.edges, "learn-edges"))
    for level in range(max_levels):
        best = best_rules(detect(current, settings), prefer=prefer, min_order=min_order)
        if best.isEmpty():
            break
        header, placed = encode(current, best, level, level, placement, settings.quant)
        header, placed = stash(header, "learn-rules"), stash(placed, "learn-placed")
        rules = header if rules is None else rules.unionByName(header)
        placements = placed if placements is None else placements.unionByName(placed)
        after = rewrite(current, best, placed)
        current = Graphs(stash(after.vertices, "learn-vertices"), stash(after.edges, "learn-edges"))
    return Grammar(rules if rules is not None else _none(spark, RULE), placements if placements is not None else _none(spark, PLACEMENT), current)


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


