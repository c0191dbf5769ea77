
import pytest
from pyspark.sql import functions as F

from shapeloom.functions.kernels import cover
from shapeloom.operators.forward import generate, sierpinski
from shapeloom.operators.graphs import Graphs
from shapeloom.operators.mining import Settings, alike, detect, groups_of
from shapeloom.operators.parsing import parse, reconstruct
from shapeloom.operators.rules import learn
from shapeloom.sources.generators import lattice


def triangles(spark):
    points = [(0, 0.0, 0.0), (1, 3.0, 0.0), (2, 1.0, 2.0)]
    rows = [("two", v + k, x + 10.0 * (k // 3), y) for k in (0, 3) for v, x, y in points]
    links = [("two", a + k, b + k) for k in (0, 3) for a, b in ((0, 1), (1, 2), (0, 2))]
    return Graphs(spark.createDataFrame(rows, "graph_id string, v long, x double, y double"), spark.createDataFrame(links, "graph_id string, u long, w long"))


def test_grid_has_frequent_squares(spark):
    found = detect(lattice(spark, 4, 4), Settings(max_order=4))
    rows = groups_of(found).where("ord = 4").collect()
    assert 9 in {r["frequency"] for r in rows if len(r["key"]["e"]) == 4}


def test_two_triangles_learned(spark):
    grammar = learn(triangles(spark))
    (rule,) = grammar.rules.collect()
    assert rule["frequency"] == 2 and rule["lhs"] == "R0"
    assert [(round(p["x"], 9), round(p["y"], 9)) for p in rule["rhs_vertices"]] == [(0, 0), (0.25, -0.75), (1, 0)]
    placed = grammar.placements.orderBy("k").collect()
    assert [[v["v"] for v in p["vertices"]] for p in placed] == [[2, 0, 1], [5, 3, 4]]
    axiom = {r["v"]: (r["x"], r["y"]) for r in grammar.axiom.vertices.collect()}
    assert axiom == {6: (0.0, 0.0), 7: (10.0, 0.0)} and grammar.axiom.edges.isEmpty()


def test_parse_and_rebuild(spark):
    graphs = generate(sierpinski(spark), 2)
    assert (graphs.vertices.count(), graphs.edges.count()) == (15, 27)
    grammar = learn(graphs, Settings(max_order=3), max_levels=2, prefer="dense", min_order=3)
    parsed = parse(graphs, grammar)
    summary = parsed.summary().first()
    assert summary["recognized"] and summary["reductions"] > 0
    again = reconstruct(parsed)
    for one, other in ((again.vertices, graphs.vertices), (again.edges, graphs.edges)):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.select(one.columns).collect()))


def test_partitions_do_not_change_groups(spark):
    graphs = lattice(spark, 3, 4)
    seen = []
    for n in (1, 7):
        spread = Graphs(graphs.vertices.repartition(n), graphs.edges.repartition(n))
        rows = groups_of(detect(spread, Settings(max_order=3))).collect()
        seen.append(sorted((r["ord"], r["frequency"], str(r["key"])) for r in rows))
    assert seen[0] == seen[1]


def test_alike_up_to_similarity(spark):
    import math

    base = triangles(spark)
    a, s = 1.1, 2.3
    turned = base.vertices.select(F.lit("turned").alias("graph_id"), "v", (s * math.cos(a) * F.col("x") - s * math.sin(a) * F.col("y") - 4).alias("x"), (s * math.sin(a) * F.col("x") + s * math.cos(a) * F.col("y") + 7).alias("y"))
    mirrored = base.vertices.select(F.lit("mirrored").alias("graph_id"), "v", -F.col("x"), "y").toDF("graph_id", "v", "x", "y")
    as_id = lambda g: base.edges.withColumn("graph_id", F.lit(g)).select("graph_id", "u", "w")
    others = Graphs(turned.unionByName(mirrored), as_id("turned").unionByName(as_id("mirrored")))
    assert [r["b"] for r in alike(base, others).collect()] == ["turned"]


@pytest.mark.parametrize("n", [3, 61])
def test_cover_is_disjoint(n):
    sets = [frozenset((i, i + 1)) for i in range(n)]
    chosen = cover(sets)
    assert len(chosen) == (n + 1) // 2 and len(set().union(*(sets[i] for i in chosen))) == 2 * len(chosen)


def test_cover_example():
    assert cover([frozenset((0, 1, 2)), frozenset((3, 4, 5)), frozenset((2, 6, 7))]) == [0, 1]




def test_placements_lead_to_the_world(spark):
    """A rule's vertices under each placement's transform stand where the covered vertices do."""
    graphs = triangles(spark)
    grammar = learn(graphs)
    world = {r["v"]: (r["x"], r["y"]) for r in graphs.vertices.collect()}
    local = {p["id"]: (p["x"], p["y"]) for p in grammar.rules.first()["rhs_vertices"]}
    for p in grammar.placements.collect():
        t = p["transform"]
        for at in p["vertices"]:
            x, y = local[at["local"]]
            assert (t["a00"] * x + t["a01"] * y + t["b0"], t["a10"] * x + t["a11"] * y + t["b1"]) == pytest.approx(world[at["v"]])


def test_grammars_of_two_graphs_stay_apart(spark):
    """Without shared a graph is reduced by its own rules only."""
    one, other = lattice(spark, 2, 4, graph_id="one"), triangles(spark)
    both = Graphs(one.vertices.unionByName(other.vertices), one.edges.unionByName(other.edges))
    grammar = learn(other, max_levels=1)
    own = parse(both, grammar, max_steps=2)
    assert {r["graph_id"] for r in own.steps.collect()} == {"two"}
    assert {r["graph_id"] for r in parse(both, grammar, max_steps=2, shared=True).steps.collect()} == {"two"}
    assert parse(one, grammar, max_steps=2).steps.isEmpty()


def test_larger_grid_has_a_greedy_cover(spark):
    """A 5x5 lattice has more edges than the exact cover takes; a cover is disjoint and no further occurrence fits."""
    from shapeloom.operators.rules import covers

    found = detect(lattice(spark, 6, 6), Settings(max_order=2))
    rows = covers(found).join(found, ["graph_id", "grp", "pos"]).collect()
    used = [v for r in rows for v in r["occ"]]
    assert found.count() == 60 and len(used) == len(set(used))
    assert all(set(r["occ"]) & set(used) for r in found.collect())


def _round_trip(graphs, **how):
    """Steps (occurrences, vertices before and after) and the summary of a parse whose input comes back exactly."""
    parsed = parse(graphs, learn(graphs, **how))
    again = reconstruct(parsed)
    for one, other in ((again.vertices, graphs.vertices), (again.edges, graphs.edges)):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.select(one.columns).collect()))
    steps = parsed.steps.orderBy("step").select("n_occurrences", "vertices_before", "vertices_after").collect()
    return [tuple(r) for r in steps], parsed.summary().first()


def test_lattice_is_one_square_of_squares(spark):
    steps, summary = _round_trip(lattice(spark, 4, 4), settings=Settings(max_order=4))
    assert steps == [(4, 16, 4), (1, 4, 1)]
    assert summary["recognized"] and summary["reductions"] == 5


def test_fractal_of_three_rounds_gives_all_its_triangles(spark):
    steps, summary = _round_trip(generate(sierpinski(spark), 3), settings=Settings(max_order=3), prefer="dense", min_order=3)
    assert steps == [(9, 42, 24)] and summary["input_edges"] == 81
