"""Graphs with coordinates as two tables: vertices(graph_id, v, x, y) and edges(graph_id, u, w) with u < w.

One pair of tables holds any number of graphs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERTEX_SCHEMA = "graph_id string, v long, x double, y double"
EDGE_SCHEMA = "graph_id string, u long, w long"
NEIGHBOUR = "struct<v:long,x:double,y:double>"


def normal_edges(pairs: DataFrame) -> DataFrame:
    """Distinct (graph_id, u, w), u < w, of any pairs (graph_id, a, b)."""
    return pairs.select("graph_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("w")).distinct()


@dataclass(frozen=True)
class Graphs:
    vertices: DataFrame
    edges: DataFrame

    def check(self) -> Graphs:
        """Raise ValueError if an edge is a loop or ends nowhere, if a vertex has two places, or a coordinate isn't finite."""
        v, e = self.vertices, self.edges
        odd = v.where(F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf")) | F.col("x").isNull() | F.col("y").isNull()).limit(1).count()
        twice = v.groupBy("graph_id", "v").count().where("count > 1").limit(1).count()
        loops = e.where("u = w").limit(1).count()
        ends = e.select("graph_id", F.explode(F.array("u", "w")).alias("v")).join(v, ["graph_id", "v"], "left_anti").limit(1).count()
        for bad, what in ((odd, "a coordinate is not finite"), (twice, "a vertex has two places"), (loops, "an edge is a loop"), (ends, "an edge ends nowhere")):
            if bad:
                raise ValueError(what)
        return self

    def adjacency(self) -> DataFrame:
        """graph_id, v, nb in both directions."""
        return self.edges.select("graph_id", F.col("u").alias("v"), F.col("w").alias("nb")).unionByName(self.edges.select("graph_id", F.col("w").alias("v"), F.col("u").alias("nb")))

    def degrees(self) -> DataFrame:
        """graph_id, v, degree; isolated vertices have 0."""
        counted = self.adjacency().groupBy("graph_id", "v").agg(F.count("*").alias("degree"))
        return self.vertices.select("graph_id", "v").join(counted, ["graph_id", "v"], "left").select("graph_id", "v", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))

    def sizes(self) -> DataFrame:
        """graph_id, n_vertices, n_edges."""
        v = self.vertices.groupBy("graph_id").agg(F.count("*").alias("n_vertices"))
        e = self.edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
        return v.join(e, "graph_id", "left").select("graph_id", "n_vertices", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"))

    def surroundings(self) -> DataFrame:
        """graph_id, v, x, y and around: the neighbours with their places, by id. One row is all that growing a pattern asks of v."""
        places = self.vertices.select("graph_id", F.col("v").alias("nb"), F.col("x").alias("nx"), F.col("y").alias("ny"))
        around = self.adjacency().join(places, ["graph_id", "nb"]).groupBy("graph_id", "v").agg(F.array_sort(F.collect_list(F.struct(F.col("nb").alias("v"), F.col("nx").alias("x"), F.col("ny").alias("y")))).alias("around"))
        return self.vertices.join(around, ["graph_id", "v"], "left").withColumn("around", F.coalesce("around", F.array().cast(f"array<{NEIGHBOUR}>")))

    def induced(self, chosen: DataFrame) -> Graphs:
        """The subgraphs on the chosen (graph_id, v); ids that a graph lacks raise KeyError."""
        chosen = chosen.select("graph_id", "v").distinct()
        if chosen.join(self.vertices, ["graph_id", "v"], "left_anti").limit(1).count():
            raise KeyError("a chosen vertex is not in its graph")
        ends = lambda c: chosen.withColumnRenamed("v", c)
        edges = self.edges.join(ends("u"), ["graph_id", "u"], "left_semi").join(ends("w"), ["graph_id", "w"], "left_semi")
        return Graphs(self.vertices.join(chosen, ["graph_id", "v"], "left_semi"), edges.select("graph_id", "u", "w"))

    def without(self, gone: DataFrame) -> Graphs:
        """Without the vertices (graph_id, v) and their edges."""
        gone = gone.select("graph_id", "v").distinct()
        edges = self.edges.join(gone.withColumnRenamed("v", "u"), ["graph_id", "u"], "left_anti").join(gone.withColumnRenamed("v", "w"), ["graph_id", "w"], "left_anti")
        return Graphs(self.vertices.join(gone, ["graph_id", "v"], "left_anti"), edges.select("graph_id", "u", "w"))

    def fresh_ids(self) -> DataFrame:
        """graph_id, fresh: the largest id plus one."""
        return self.vertices.groupBy("graph_id").agg((F.max("v") + 1).alias("fresh"))

    def contract(self, mapping: DataFrame, places: DataFrame) -> Graphs:
        """The quotient: vertices of mapping (graph_id, v, node) become their nodes, which stand at places (graph_id, v, x, y).

        Edges within a node go, edges between the same two ends are one.
        """
        to = mapping.select("graph_id", "v", "node")
        end = lambda c: to.select("graph_id", F.col("v").alias(c), F.col("node").alias(f"{c}_node"))
        moved = self.edges.join(end("u"), ["graph_id", "u"], "left").join(end("w"), ["graph_id", "w"], "left")
        moved = moved.select("graph_id", F.coalesce("u_node", "u").alias("a"), F.coalesce("w_node", "w").alias("b")).where("a <> b")
        kept = self.vertices.join(to, ["graph_id", "v"], "left_anti")
        return Graphs(kept.select("graph_id", "v", "x", "y").unionByName(places.select("graph_id", "v", "x", "y")), normal_edges(moved))


def has_edges(graphs: Graphs, asked: DataFrame) -> DataFrame:
    """The asked pairs (graph_id, a, b) with a column `there`."""
    pairs = asked.select("*", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("w"))
    found = pairs.join(graphs.edges.withColumn("there", F.lit(True)), ["graph_id", "u", "w"], "left")
    return found.select(*asked.columns, F.coalesce("there", F.lit(False)).alias("there"))
