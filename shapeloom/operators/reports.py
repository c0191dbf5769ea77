"""Statistics of mined shapes and learned grammars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import Graphs
from .mining import groups_of
from .rules import Grammar


def order_histogram(occurrences: DataFrame) -> DataFrame:
    """graph_id, ord, groups, max_frequency."""
    return groups_of(occurrences).groupBy("graph_id", "ord").agg(F.count("*").alias("groups"), F.max("frequency").alias("max_frequency"))


def rule_stats(grammar: Grammar) -> DataFrame:
    """graph_id, rule_id, level, ord, n_edges, frequency, encoded, saved."""
    encoded = grammar.placements.groupBy("graph_id", "rule_id").agg(F.count("*").alias("encoded"))
    order = F.size("rhs_vertices")
    rules = grammar.rules.join(encoded, ["graph_id", "rule_id"], "left").na.fill(0, ["encoded"])
    return rules.select("graph_id", "rule_id", "level", order.alias("ord"), F.size("rhs_edges").alias("n_edges"), "frequency", "encoded", ((order - 1) * F.col("encoded")).alias("saved"))


def grammar_stats(graphs: Graphs, grammar: Grammar) -> DataFrame:
    """graph_id, input_vertices, input_edges, n_rules, levels, axiom_vertices, vertices_saved, compression_ratio."""
    sums = rule_stats(grammar).groupBy("graph_id").agg(F.count("*").alias("n_rules"), (F.max("level") + 1).alias("levels"), F.sum("saved").alias("vertices_saved"))
    size = graphs.sizes().select("graph_id", F.col("n_vertices").alias("input_vertices"), F.col("n_edges").alias("input_edges"))
    left = (grammar.axiom or graphs).sizes().select("graph_id", F.col("n_vertices").alias("axiom_vertices"))
    out = size.join(left, "graph_id", "left").join(sums, "graph_id", "left").na.fill(0, ["n_rules", "levels", "vertices_saved", "axiom_vertices"])
    return out.withColumn("compression_ratio", F.when(F.col("input_vertices") > 0, F.col("vertices_saved") / F.col("input_vertices")).otherwise(0.0))
