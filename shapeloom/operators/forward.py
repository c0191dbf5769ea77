"""Generation: rewrite all modules in parallel, then draw their terminal shapes into one graph."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from .graphs import Graphs, normal_edges


@dataclass(frozen=True)
class ForwardGrammar:
    """axiom(path, sym, frame); productions(sym, child, child_sym, step); terminals as vertices (sym, v, x, y) and edges (sym, u, w)."""

    axiom: DataFrame
    productions: DataFrame
    terminal_vertices: DataFrame
    terminal_edges: DataFrame


def derive(grammar: ForwardGrammar, iterations: int) -> DataFrame:
    """Modules (path, sym, frame) after so many rounds; a symbol without production stays. path orders them."""
    modules = grammar.axiom
    rules = grammar.productions
    for _ in range(iterations):
        joined = modules.join(rules, "sym", "left")
        modules = joined.select(
            F.concat("path", F.array(F.coalesce("child", F.lit(0)))).alias("path"),
            F.coalesce("child_sym", "sym").alias("sym"),
            F.when(F.col("child").isNull(), F.col("frame")).otherwise(G.compose(F.col("frame"), F.col("step"))).alias("frame"),
        )
    return modules


def render(grammar: ForwardGrammar, modules: DataFrame, merge_tol: float = 1e-6, graph_id: str = "generated") -> Graphs:
    """One graph of all modules' shapes. Points in one cell of size merge_tol (halves to even) are one vertex, at the first
    one's place; ids follow the first appearance in module order. Symbols without a shape are dropped."""
    drawn = modules.join(grammar.terminal_vertices, "sym")
    x, y = G.apply_x(F.col("frame"), F.col("x"), F.col("y")), G.apply_y(F.col("frame"), F.col("x"), F.col("y"))
    drawn = drawn.select("path", "v", x.alias("x"), y.alias("y"))
    drawn = drawn.select("*", F.rint(F.col("x") / merge_tol).cast("long").alias("qx"), F.rint(F.col("y") / merge_tol).cast("long").alias("qy"))
    cells = drawn.groupBy("qx", "qy").agg(F.min(F.struct("path", "v", "x", "y")).alias("first"))
    # Dense ids need one ordering of all vertices of the one graph; the rows are small.
    cells = cells.withColumn("id", F.row_number().over(Window.orderBy("first.path", "first.v")).cast("long") - 1)
    vertices = cells.select(F.lit(graph_id).alias("graph_id"), F.col("id").alias("v"), "first.x", "first.y")
    named = drawn.join(cells.select("qx", "qy", "id"), ["qx", "qy"]).select("path", "v", "id")
    shaped = modules.select("path", "sym").join(grammar.terminal_edges, "sym")
    end = lambda c: named.select("path", F.col("v").alias(c), F.col("id").alias(f"{c}_id"))
    edges = shaped.join(end("u"), ["path", "u"]).join(end("w"), ["path", "w"]).where("u_id <> w_id")
    return Graphs(vertices, normal_edges(edges.select(F.lit(graph_id).alias("graph_id"), F.col("u_id").alias("a"), F.col("w_id").alias("b"))))


def generate(grammar: ForwardGrammar, iterations: int, merge_tol: float = 1e-6) -> Graphs:
    return render(grammar, derive(grammar, iterations), merge_tol)


def sierpinski(spark: SparkSession) -> ForwardGrammar:
    """One symbol S: a unit triangle that becomes three half-size copies at its corners."""
    h = math.sqrt(3.0) / 2.0
    half = lambda dx, dy: (0.5, 0.0, 0.0, 0.5, dx, dy)
    frame = f"struct<path:array<int>,sym:string,frame:{G.SIMILARITY}>"
    axiom = spark.createDataFrame([([], "S", (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))], frame)
    children = [("S", i, "S", half(dx, dy)) for i, (dx, dy) in enumerate([(0.0, 0.0), (0.5, 0.0), (0.25, h / 2.0)])]
    productions = spark.createDataFrame(children, f"struct<sym:string,child:int,child_sym:string,step:{G.SIMILARITY}>")
    corners = spark.createDataFrame([("S", 0, 0.0, 0.0), ("S", 1, 1.0, 0.0), ("S", 2, 0.5, h)], "sym string, v long, x double, y double")
    sides = spark.createDataFrame([("S", 0, 1), ("S", 1, 2), ("S", 0, 2)], "sym string, u long, w long")
    return ForwardGrammar(axiom, productions, corners, sides)


EXAMPLES = {"sierpinski": sierpinski}
