"""Clean-up of street networks: long edges, components, shape points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import dissolve_degree2
from ..sources.scratch import shuffled, stash
from .graphs import Graphs


def edge_lengths(graphs: Graphs) -> DataFrame:
    """graph_id, u, w, length."""
    end = lambda c: graphs.vertices.select("graph_id", F.col("v").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    both = graphs.edges.join(end("u"), ["graph_id", "u"]).join(end("w"), ["graph_id", "w"])
    return both.select("graph_id", "u", "w", F.hypot(F.col("ux") - F.col("wx"), F.col("uy") - F.col("wy")).alias("length"))


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """graph_id, median: the value at place n div 2 of the sorted ones, found from counts of equal values."""
    counts = rows.groupBy("graph_id", value).agg(F.count("*").alias("n"))
    by = Window.partitionBy("graph_id")
    seen = counts.select("graph_id", value, F.sum("n").over(by.orderBy(value)).alias("upto"), F.sum("n").over(by).alias("total"))
    return seen.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("graph_id").agg(F.min(value).alias("median"))


def trim_long_edges(graphs: Graphs, factor: float) -> Graphs:
    """Without the edges longer than factor times their graph's upper median length; all vertices stay."""
    lengths = edge_lengths(graphs)
    kept = lengths.join(upper_median(lengths, "length"), "graph_id").where(F.col("length") <= factor * F.col("median"))
    return Graphs(graphs.vertices, kept.select("graph_id", "u", "w"))


def component_labels(graphs: Graphs) -> DataFrame:
    """graph_id, v, component (its least id). Labels move to neighbours and then to their label's label until none changes."""
    links = stash(graphs.adjacency(), "component-links")
    labels = stash(graphs.vertices.select("graph_id", "v", F.col("v").alias("component")), "component-labels")
    while True:
        sent = links.join(shuffled(labels), ["graph_id", "v"]).groupBy("graph_id", "nb").agg(F.min("component").alias("least")).withColumnRenamed("nb", "v")
        near = labels.join(shuffled(sent), ["graph_id", "v"], "left").select("graph_id", "v", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        root = near.select("graph_id", F.col("v").alias("component"), F.col("component").alias("further"))
        jumped = near.join(shuffled(root), ["graph_id", "component"], "left").select("graph_id", "v", "old", F.coalesce("further", "component").alias("component"))
        jumped = stash(jumped, "component-labels")
        if jumped.where("old <> component").isEmpty():
            return jumped.select("graph_id", "v", "component")
        labels = jumped.select("graph_id", "v", "component")


def largest_component(graphs: Graphs) -> Graphs:
    """The component with the most vertices of each graph; of equals the one with the least id."""
    labels = component_labels(graphs)
    sizes = labels.groupBy("graph_id", "component").agg(F.count("*").alias("n"))
    best = sizes.groupBy("graph_id").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    chosen = labels.join(shuffled(best), ["graph_id", "component"], "left_semi").select("graph_id", "v")
    edges = graphs.edges.join(shuffled(chosen.withColumnRenamed("v", "u")), ["graph_id", "u"], "left_semi")
    return Graphs(graphs.vertices.join(shuffled(chosen), ["graph_id", "v"], "left_semi"), edges.select("graph_id", "u", "w"))


def simplify_degree2(graphs: Graphs) -> Graphs:
    """Dissolve all vertices with exactly two neighbours. The result depends on the order, so each component is one task's."""
    labels = component_labels(graphs)
    linked = graphs.edges.join(shuffled(labels.withColumnRenamed("v", "u")), ["graph_id", "u"]).select("graph_id", "component", "u", "w")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for u, w in zip(df["u"], df["w"], strict=True):
            near.setdefault(u, set()).add(w)
            near.setdefault(w, set()).add(u)
        edges = sorted(dissolve_degree2(near))
        return pd.DataFrame({"graph_id": df["graph_id"].iloc[0], "u": [e[0] for e in edges], "w": [e[1] for e in edges]})

    edges = stash(linked.groupBy("graph_id", "component").applyInPandas(run, "graph_id string, u long, w long"), "simplified")
    alone = graphs.vertices.join(shuffled(graphs.adjacency()), ["graph_id", "v"], "left_anti").select("graph_id", "v")
    kept = edges.select("graph_id", F.explode(F.array("u", "w")).alias("v")).unionByName(alone).distinct()
    return Graphs(graphs.vertices.join(shuffled(kept), ["graph_id", "v"], "left_semi"), edges)
