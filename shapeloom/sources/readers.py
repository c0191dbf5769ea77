"""Graphs and signals from files: graph and grammar JSON, street-network JSON, EDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.kernels import edf_channel
from ..operators.graphs import Graphs, normal_edges

_POINT = "struct<id:bigint,x:double,y:double>"
_TRANSFORM = "struct<linear:array<array<double>>,translation:array<double>>"
GRAPH_JSON = f"vertices array<{_POINT}>, edges array<array<bigint>>"
GRAMMAR_JSON = (
    "format string, version int, dimension int, transform_class string, "
    f"axiom struct<vertices:array<struct<id:bigint,x:double,y:double,frame:{_TRANSFORM}>>,edges:array<array<bigint>>>, "
    "rules array<struct<id:int,level:int,frequency:bigint,lhs:struct<symbol:string>,"
    "rhs:struct<vertices:array<struct<id:int,x:double,y:double,symbol:string>>,edges:array<array<int>>>,"
    f"embedding:array<struct<vertex:int,transform:{_TRANSFORM},connections:array<array<double>>>>,"
    f"occurrences:array<struct<transform:{_TRANSFORM},vertices:array<array<bigint>>,node:array<double>>>>>"
)
OSM_JSON = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("graph_id", F.input_file_name())


def graph_json(spark: SparkSession, path: str) -> Graphs:
    """One graph for each file; edges that repeat are one, missing edges are none."""
    files = _json(spark, path, GRAPH_JSON)
    vertices = files.select("graph_id", F.explode("vertices").alias("p")).select("graph_id", F.col("p.id").alias("v"), "p.x", "p.y")
    # Grouping keys lose the sign of -0.0; the first value keeps it.
    vertices = vertices.groupBy("graph_id", "v", F.col("x").alias("kx"), F.col("y").alias("ky")).agg(F.first("x").alias("x"), F.first("y").alias("y")).drop("kx", "ky")
    pairs = files.select("graph_id", F.explode("edges").alias("e")).select("graph_id", F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))
    return Graphs(vertices, normal_edges(pairs))


def _similarity(t: Column) -> Column:
    m, s = t["linear"], t["translation"]
    return G.similarity(m[0][0], m[0][1], m[1][0], m[1][1], s[0], s[1])


def grammar_json(spark: SparkSession, path: str):
    """A Grammar (rules, placements, axiom) for each file; the header is not checked, a null axiom has no vertices."""
    from ..operators.rules import Grammar

    files = _json(spark, path, GRAMMAR_JSON)
    r = F.col("r")
    rule = files.select("graph_id", F.explode("rules").alias("r"))
    rules = rule.select(
        "graph_id",
        r["id"].alias("rule_id"),
        r["lhs"]["symbol"].alias("lhs"),
        r["level"].alias("level"),
        r["frequency"].alias("frequency"),
        r["rhs"]["vertices"].alias("rhs_vertices"),
        F.transform(r["rhs"]["edges"], lambda e: F.struct(e[0].alias("u"), e[1].alias("w"))).alias("rhs_edges"),
        F.transform(
            r["embedding"],
            lambda e: F.struct(e["vertex"], _similarity(e["transform"]).alias("transform"), F.transform(e["connections"], lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))).alias("connections")),
        ).alias("embedding"),
    )
    o = F.col("o")
    placed = rule.select("graph_id", r["id"].alias("rule_id"), F.posexplode(r["occurrences"]).alias("k", "o"))
    placed = placed.select(
        "graph_id",
        "rule_id",
        "k",
        _similarity(o["transform"]).alias("transform"),
        F.transform(o["vertices"], lambda p: F.struct(p[0].cast("int").alias("local"), p[1].alias("v"))).alias("vertices"),
        F.get(o["node"], F.lit(0)).alias("node_x"),
        F.get(o["node"], F.lit(1)).alias("node_y"),
    )
    axis = files.where("axiom IS NOT NULL")
    vertices = axis.select("graph_id", F.explode("axiom.vertices").alias("p")).select("graph_id", F.col("p.id").alias("v"), "p.x", "p.y")
    pairs = axis.select("graph_id", F.explode("axiom.edges").alias("e")).select("graph_id", F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))
    return Grammar(rules, placed, Graphs(vertices, normal_edges(pairs)))


def street_json(spark: SparkSession, path: str, simplify: bool = True) -> Graphs:
    """Street networks, one for each file (see street_graph)."""
    return street_graph(_json(spark, path, OSM_JSON).select("graph_id", F.explode("elements").alias("e")).select("graph_id", "e.*"), simplify)


def street_graph(elements: DataFrame, simplify: bool = True) -> Graphs:
    """Graphs of elements (graph_id, type, id, lat, lon, nodes), projected to metres around the mean of all nodes.

    References to missing nodes are dropped before neighbours are linked; only linked nodes stay. No node at all: ValueError.
    """
    from ..operators.networks import simplify_degree2

    nodes = elements.where("type = 'node'").select("graph_id", F.col("id").alias("v"), "lat", "lon").dropDuplicates(["graph_id", "v"])
    if nodes.isEmpty():
        raise ValueError("there are no nodes")
    centre = nodes.groupBy("graph_id").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    steps = elements.where("type = 'way'").select("graph_id", F.col("id").alias("way"), F.posexplode("nodes").alias("at", "v")).join(nodes, ["graph_id", "v"])
    along = Window.partitionBy("graph_id", "way").orderBy("at")
    edges = normal_edges(steps.select("graph_id", F.col("v").alias("a"), F.lead("v").over(along).alias("b")).where("b IS NOT NULL AND a <> b"))
    used = edges.select("graph_id", F.explode(F.array("u", "w")).alias("v")).distinct()
    placed = nodes.join(used, ["graph_id", "v"], "left_semi").join(centre, "graph_id")
    x, y = G.project_x(F.col("lon"), F.col("lat0"), F.col("lon0")), G.project_y(F.col("lat"), F.col("lat0"))
    graphs = Graphs(placed.select("graph_id", "v", x.alias("x"), y.alias("y")), edges)
    return simplify_degree2(graphs) if simplify else graphs


def edf(spark: SparkSession, path: str, channel: int = 0) -> DataFrame:
    """signal(series_id, i, x, fs) of one channel of each EDF file."""
    schema = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("i", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("fs", T.DoubleType())])

    def run(frames):
        for df in frames:
            for name, data in zip(df["path"], df["content"], strict=True):
                x, fs = edf_channel(bytes(data), channel)
                yield pd.DataFrame({"series_id": name, "i": np.arange(len(x)), "x": x, "fs": fs})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


# Fixed values of the public map service: road classes, and areas as (south, west, north, east).
ROADS = "motorway|trunk|primary|secondary|tertiary|unclassified|residential|living_street"
FOOTPATHS = ROADS + "|pedestrian|footway|path|track"
AREAS = {
    "barcelona-eixample": (41.388, 2.160, 41.395, 2.170),
    "manhattan-midtown": (40.745, -73.990, 40.760, -73.970),
    "fez-medina": (34.058, -4.985, 34.070, -4.968),
    "marrakesh-medina": (31.620, -8.000, 31.636, -7.980),
    "kano-old-city": (11.985, 8.505, 12.005, 8.525),
    "accra-jamestown": (5.524, -0.220, 5.534, -0.206),
    "kumasi-centre": (6.683, -1.630, 6.697, -1.616),
}


def street_query(area: tuple[float, float, float, float], roads: str = ROADS) -> str:
    """The map service's query for the ways of an area and their nodes; its answer, stored as a file, is for street_json."""
    box = ",".join(map(str, area))
    return f'[out:json][timeout:120];way["highway"~"{roads}"]({box});(._;>;);out body;'
