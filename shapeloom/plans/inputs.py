"""Graphs and series from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import signals
from ..operators.graphs import Graphs


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values in the order of time: signal(series_id, i, x)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").cast("string").alias("series_id"), (F.row_number().over(by) - 1).cast("long").alias("i"), F.col("value").alias("x"))


def trajectories(spark: SparkSession, sf_dir: str, tau: int = 1) -> Graphs:
    """Paths through (x[i], x[i + tau]) of all users."""
    return signals.trajectory(signals.phase_space(series(spark, sf_dir), tau, normalize=False))


def embedding_paths(spark: SparkSession, sf_dir: str) -> Graphs:
    """For each label a path, by vec_id, through the first two components."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: F.col("embedding")[k].cast("double")
    vertices = rows.select(F.col("label").cast("string").alias("graph_id"), F.col("vec_id").alias("v"), at(0).alias("x"), at(1).alias("y"))
    edges = vertices.select("graph_id", F.col("v").alias("u"), F.lead("v").over(Window.partitionBy("graph_id").orderBy("v")).alias("w")).where("w IS NOT NULL")
    return Graphs(vertices, edges)


def supply_graph(spark: SparkSession, sf_dir: str) -> Graphs:
    """Suppliers (negative ids) and the parts they deliver; places from balance or price, and key."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    one = lambda: F.lit("supply").alias("graph_id")
    suppliers = read("supplier").select(one(), (-F.col("s_suppkey") - 1).alias("v"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    parts = read("part").select(one(), F.col("p_partkey").alias("v"), F.col("p_retailprice").alias("x"), F.col("p_partkey").cast("double").alias("y"))
    edges = read("lineitem").select((-F.col("l_suppkey") - 1).alias("u"), F.col("l_partkey").alias("w")).distinct()
    return Graphs(suppliers.unionByName(parts), edges.select(one(), "u", "w"))
