"""Recognition: reduce graphs by the rules of a grammar, keep what each step undid, and rebuild the graphs from that."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import canonical
from ..sources.scratch import stash
from .graphs import Graphs, normal_edges
from .mining import KEY, Settings, detect, key_struct
from .rules import Grammar, covers

#: Placeholders begin here, or above the largest id of the input.
NODE_BASE = 10_000_000
STEP = "graph_id string, step int, rule_id int, symbol string, level int, order int, n_occurrences long, vertices_before long, vertices_after long"
UNDO = (
    "graph_id string, step int, k int, node long, node_x double, node_y double, vertices array<struct<v:long,x:double,y:double>>, "
    "internal array<struct<u:long,w:long>>, boundary array<struct<v:long,nb:long>>"
)


@dataclass(frozen=True)
class Parsed:
    steps: DataFrame
    undo: DataFrame
    reduced: Graphs
    source: Graphs

    def summary(self) -> DataFrame:
        """graph_id, sizes of input and result, n_steps, reductions, recognized."""
        size = lambda g, p: g.sizes().select("graph_id", F.col("n_vertices").alias(f"{p}_vertices"), F.col("n_edges").alias(f"{p}_edges"))
        steps = self.steps.groupBy("graph_id").agg(F.count("*").alias("n_steps"), F.sum("n_occurrences").alias("reductions"))
        both = size(self.source, "input").join(size(self.reduced, "reduced"), "graph_id").join(steps, "graph_id", "left").na.fill(0, ["n_steps", "reductions"])
        return both.withColumn("recognized", F.col("reduced_vertices") < F.col("input_vertices"))


def rule_keys(grammar: Grammar, quant: float) -> DataFrame:
    """graph_id, rule_id, symbol, level, order, key of every rule's right side."""

    def run(frames):
        for df in frames:
            rows = []
            for r in df.itertuples(index=False):
                ids = [int(v["id"]) for v in r.rhs_vertices]
                points = np.array([(v["x"], v["y"]) for v in r.rhs_vertices])
                key = canonical(ids, points, [(int(e["u"]), int(e["w"])) for e in r.rhs_edges], quant).key
                rows.append((r.graph_id, r.rule_id, r.lhs, r.level, len(ids), key_struct(key)))
            yield pd.DataFrame(rows, columns=["graph_id", "rule_id", "symbol", "level", "order", "key"])

    return grammar.rules.select("graph_id", "rule_id", "lhs", "level", "rhs_vertices", "rhs_edges").mapInPandas(run, f"graph_id string, rule_id int, symbol string, level int, order int, key {KEY}")


def _reduce(graphs: Graphs, chosen: DataFrame, step: int, placement: str) -> tuple[DataFrame, Graphs]:
    """Undo rows of a step and the graphs after it. chosen: graph_id, k, node, occ, replaced in the order of k."""
    flat = chosen.select("graph_id", "k", "node", F.explode("occ").alias("v"))
    placed = flat.join(graphs.vertices, ["graph_id", "v"])
    other = flat.select("graph_id", F.col("v").alias("nb"), F.col("k").alias("nb_k"), F.col("node").alias("nb_node"))
    links = flat.join(graphs.adjacency(), ["graph_id", "v"]).join(other, ["graph_id", "nb"], "left")
    # What the k-th replacement sees: neighbours in an earlier sibling are that sibling's node by then.
    seen = links.withColumn("live", F.when(F.col("nb_k") < F.col("k"), F.col("nb_node")).otherwise(F.col("nb")))
    inside = seen.where("nb_k = k AND v < nb").groupBy("graph_id", "k").agg(F.sort_array(F.collect_set(F.struct(F.col("v").alias("u"), F.col("nb").alias("w")))).alias("internal"))
    border = seen.where("nb_k IS NULL OR nb_k <> k").groupBy("graph_id", "k").agg(F.sort_array(F.collect_set(F.struct("v", F.col("live").alias("nb")))).alias("boundary"))
    own = placed.groupBy("graph_id", "k", "node").agg(F.array_sort(F.collect_list(F.struct("v", "x", "y"))).alias("vertices"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    if placement == "centroid":
        own = own.select("*", F.col("cx").alias("node_x"), F.col("cy").alias("node_y"))
    else:
        degree = seen.groupBy("graph_id", "k", "v").agg(F.countDistinct("live").alias("degree"))
        top = placed.join(degree, ["graph_id", "k", "v"], "left").groupBy("graph_id", "k").agg(F.max_by(F.struct("x", "y"), F.struct(F.coalesce("degree", F.lit(0)), -F.col("v"))).alias("p"))
        own = own.join(top, ["graph_id", "k"]).select("*", F.col("p.x").alias("node_x"), F.col("p.y").alias("node_y"))
    undo = own.join(inside, ["graph_id", "k"], "left").join(border, ["graph_id", "k"], "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    undo = undo.select("graph_id", F.lit(step).alias("step"), "k", "node", "node_x", "node_y", "vertices", empty("internal", "array<struct<u:long,w:long>>"), empty("boundary", "array<struct<v:long,nb:long>>"))
    undo = stash(undo, "parse-undo")
    nodes = undo.select("graph_id", F.col("node").alias("v"), F.col("node_x").alias("x"), F.col("node_y").alias("y"))
    after = graphs.contract(flat.select("graph_id", "v", "node"), nodes)
    return undo, Graphs(stash(after.vertices, "parse-vertices"), stash(after.edges, "parse-edges"))


def parse(graphs: Graphs, grammar: Grammar, placement: str = "centroid", quant: float = 0.05, max_steps: int = 100_000, settings: Settings | None = None, shared: bool = False) -> Parsed:
    """Reduce every graph until no rule fits. In each step the first rule, by level, order and id, that occurs is applied to its cover.

    A graph is reduced by the rules of its own graph_id, or with shared by the rules of all, whatever their graph_id; of
    shared rules that agree in level, order and id the one of the least graph_id is first.
    """
    spark = graphs.vertices.sparkSession
    keys = stash(rule_keys(grammar, quant), "parse-keys")
    largest = keys.agg(F.max("order")).first()[0] or 2
    settings = replace(settings or Settings(), quant=quant, min_frequency=1, max_order=largest, frequency_cut=0.0)
    on = ["key"] if shared else ["graph_id", "key"]
    rank = F.struct("level", "order", "rule_id", F.col("rule_graph") if shared else F.lit(""))
    ranked = keys.withColumnRenamed("graph_id", "rule_graph") if shared else keys
    base = graphs.vertices.groupBy("graph_id").agg(F.greatest(F.lit(NODE_BASE).cast("long"), F.max("v") + 1).alias("next"))
    counter = stash(base, "parse-counter")
    current = Graphs(stash(graphs.vertices, "parse-vertices"), stash(graphs.edges, "parse-edges"))
    active, steps, undo = current, None, None
    for step in range(max_steps):
        found = detect(active, settings)
        fits = found.where("pos = grp").join(ranked, on).groupBy("graph_id").agg(F.min_by(F.struct("grp", "rule_id", "symbol", "level", "order"), rank).alias("r"))
        fits = stash(fits.select("graph_id", "r.*"), "parse-fits")
        if fits.isEmpty():
            break
        mine = found.join(fits, ["graph_id", "grp"]).select("graph_id", "grp", "pos", "occ")
        k = F.row_number().over(Window.partitionBy("graph_id").orderBy("pos")) - 1
        chosen = covers(mine).join(mine, ["graph_id", "grp", "pos"]).withColumn("k", k)
        chosen = stash(chosen.join(counter, "graph_id").select("graph_id", "k", (F.col("next") + F.col("k")).alias("node"), "occ"), "parse-chosen")
        before = current.sizes().select("graph_id", F.col("n_vertices").alias("vertices_before"))
        rows, current = _reduce(current, chosen, step, placement)
        n = chosen.groupBy("graph_id").agg(F.count("*").alias("n_occurrences"))
        after = current.sizes().select("graph_id", F.col("n_vertices").alias("vertices_after"))
        line = fits.join(n, "graph_id").join(before, "graph_id").join(after, "graph_id").select(
            "graph_id", F.lit(step).alias("step"), "rule_id", "symbol", "level", "order", "n_occurrences", "vertices_before", "vertices_after"
        )
        line = stash(line, "parse-step")
        steps = line if steps is None else steps.unionByName(line)
        undo = rows if undo is None else undo.unionByName(rows)
        counter = stash(counter.join(n, "graph_id", "left").select("graph_id", (F.col("next") + F.coalesce("n_occurrences", F.lit(0))).alias("next")), "parse-counter")
        # Graphs that no rule fitted are done.
        still = fits.select("graph_id")
        active = Graphs(current.vertices.join(still, "graph_id", "left_semi"), current.edges.join(still, "graph_id", "left_semi"))
    return Parsed(steps if steps is not None else spark.createDataFrame([], STEP), undo if undo is not None else spark.createDataFrame([], UNDO), current, graphs)


def reconstruct(parsed: Parsed) -> Graphs:
    """The input graphs again, from the reduced ones and the undo rows, last step first.

    In a step all placeholders go and all vertices and inner edges come back before the outer edges, of which those count
    whose other end is there: a sibling's placeholder isn't any more, but then the sibling has logged the edge itself.
    """
    current = parsed.reduced
    last = parsed.undo.agg(F.max("step")).first()[0]
    for step in range(-1 if last is None else last, -1, -1):
        rows = parsed.undo.where(F.col("step") == step)
        gone = rows.select("graph_id", F.col("node").alias("v"))
        kept = current.without(gone)
        back = rows.select("graph_id", F.explode("vertices").alias("p")).select("graph_id", "p.v", "p.x", "p.y")
        vertices = stash(kept.vertices.select("graph_id", "v", "x", "y").unionByName(back), "rebuild-vertices")
        inner = rows.select("graph_id", F.explode("internal").alias("e")).select("graph_id", F.col("e.u").alias("a"), F.col("e.w").alias("b"))
        outer = rows.select("graph_id", F.explode("boundary").alias("e")).select("graph_id", F.col("e.v").alias("a"), F.col("e.nb").alias("b"))
        outer = outer.join(vertices.select("graph_id", F.col("v").alias("b")), ["graph_id", "b"], "left_semi").select("graph_id", "a", "b")
        old = kept.edges.select("graph_id", F.col("u").alias("a"), F.col("w").alias("b"))
        current = Graphs(vertices, stash(normal_edges(old.unionByName(inner).unionByName(outer)), "rebuild-edges"))
    return current
