import json

import numpy as np
import pytest
from test_kernels import edf_bytes

from shapeloom.operators import networks, signals
from shapeloom.operators.graphs import Graphs
from shapeloom.sources import generators, readers, writers
from shapeloom.streaming.trajectories import stream_points


def test_graph_json_round_trip(spark, tmp_path):
    data = {"vertices": [{"id": 1, "x": 0.1, "y": -0.0}, {"id": 5, "x": 6.1e-17, "y": 2.0}, {"id": 9, "x": 1.0, "y": 1.0}], "edges": [[1, 5], [5, 9]]}
    path = tmp_path / "g.json"
    path.write_text(json.dumps(data))
    graphs = readers.graph_json(spark, str(path)).check()
    name = graphs.vertices.first()["graph_id"]
    assert json.dumps(writers.graph_dict(graphs, name)) == json.dumps(data)


def test_grammar_json_round_trip(spark, tmp_path):
    turn = {"linear": [[0.5, -0.0], [6.1e-17, 0.5]], "translation": [1.0, 2.0]}
    rule = {
        "id": 0, "lhs": {"symbol": "A"}, "level": 0, "frequency": 7,
        "rhs": {"vertices": [{"id": 0, "x": 0.0, "y": 0.0, "symbol": "B"}, {"id": 1, "x": 1.0, "y": 0.0}], "edges": [[0, 1]]},
        "embedding": [{"vertex": 0, "transform": turn, "connections": [[0.25, 0.75]]}],
        "occurrences": [{"transform": turn, "vertices": [[0, 4], [1, 2]], "node": [1.0, 2.0]}, {"transform": turn, "vertices": [[0, 7], [1, 8]]}],
    }
    data = {"format": "ggg-2d", "version": 1, "dimension": 2, "transform_class": "similarity", "axiom": None, "rules": [rule]}
    path = tmp_path / "a.json"
    path.write_text(json.dumps(data))
    grammar = readers.grammar_json(spark, str(path))
    name = grammar.rules.first()["graph_id"]
    assert json.dumps(writers.grammar_dict(grammar, name)["rules"]) == json.dumps(data["rules"])
    assert "0\tA\t0\t7\t2\t2\t1" in writers.grammar_text(grammar, name)


def streets(spark, ways):
    nodes = [("m", "node", i, 10.0 + i / 1000, 20.0 + (i % 2) / 1000, None) for i in range(1, 6)]
    rows = nodes + [("m", "way", 100 + k, None, None, w) for k, w in enumerate(ways)]
    return spark.createDataFrame(rows, "graph_id string, type string, id long, lat double, lon double, nodes array<bigint>")


def test_streets(spark):
    chain = streets(spark, [[1, 2, 3], [3, 4], [4, 99]])
    raw = readers.street_graph(chain, simplify=False)
    assert (raw.vertices.count(), raw.edges.count()) == (4, 3)
    plain = readers.street_graph(chain)
    assert [tuple(r)[1:] for r in plain.edges.collect()] == [(1, 4)] and plain.vertices.count() == 2
    fork = readers.street_graph(streets(spark, [[1, 2], [2, 3], [2, 4]]))
    assert fork.degrees().where("v = 2").first()["degree"] == 3
    with pytest.raises(ValueError):
        readers.street_graph(streets(spark, [[1, 2]]).where("type = 'way'"))


def test_components_and_trim(spark):
    v = [("g", i, float(i if i < 4 else 100 * i), 0.0) for i in range(6)]
    graphs = Graphs(spark.createDataFrame(v, "graph_id string, v long, x double, y double"), spark.createDataFrame([("g", 0, 1), ("g", 1, 2), ("g", 2, 3), ("g", 3, 4), ("g", 4, 5)], "graph_id string, u long, w long"))
    trimmed = networks.trim_long_edges(graphs, 2.0)
    assert trimmed.edges.count() == 3 and trimmed.vertices.count() == 6
    assert sorted(r["v"] for r in networks.largest_component(trimmed).vertices.collect()) == [0, 1, 2, 3]


def test_bad_graphs(spark):
    v = spark.createDataFrame([("g", 0, 0.0, 0.0), ("g", 1, 1.0, 0.0)], "graph_id string, v long, x double, y double")
    edge = lambda u, w: spark.createDataFrame([("g", u, w)], "graph_id string, u long, w long")
    for bad in (edge(0, 0), edge(0, 7)):
        with pytest.raises(ValueError):
            Graphs(v, bad).check()
    with pytest.raises(KeyError):
        Graphs(v, edge(0, 1)).induced(spark.createDataFrame([("g", 9)], "graph_id string, v long"))


def test_signals(spark, tmp_path):
    wave = [("a", i, float(np.sin(2 * np.pi * 10 * i / 160))) for i in range(800)]
    signal = spark.createDataFrame(wave, "series_id string, i long, x double")
    assert 3 <= signals.estimate_tau(signal).first()["tau"] <= 5
    graphs, facts = signals.signal_graph(signal, 160.0, count=30, start=5)
    assert (graphs.vertices.count(), graphs.edges.count()) == (30, 29) and facts.first()["series_id"] == "a"
    with pytest.raises(ValueError):
        signals.phase_space(signal, 0)
    assert signals.phase_space(signal, 5).count() == 795
    path = tmp_path / "x.edf"
    path.write_bytes(edf_bytes([[0, 50, -50, 100]]))
    assert [r["x"] for r in readers.edf(spark, str(path)).orderBy("i").collect()] == [0.0, 0.5, -0.5, 1.0]
    assert generators.synthetic_signal(spark, 100).count() == 100


def test_stream_gives_the_stored_points(spark, tmp_path):
    rows = [(s, i, float(i * i + len(s))) for s in ("a", "bb") for i in range(20)]
    schema = "series_id string, i long, x double"
    for k, part in enumerate((rows[:7] + rows[20:31], rows[7:20] + rows[31:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            q = stream_points(stream, 3).writeStream.format("memory").queryName("points").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM points").collect()))
    want = signals.phase_space(spark.createDataFrame(rows, schema), 3, normalize=False).select("series_id", "i", "px", "py")
    assert got == sorted(map(tuple, want.collect()))


def test_components_without_broadcasts(spark):
    """Tables of ids have small files and many rows: none of them may go through the driver."""
    path = [("g", i, float(i), 0.0) for i in range(400)]
    graphs = Graphs(spark.createDataFrame(path, "graph_id string, v long, x double, y double"), spark.createDataFrame([("g", i, i + 1) for i in range(399)], "graph_id string, u long, w long"))
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "1k")
    try:
        plain = networks.simplify_degree2(graphs)
        assert [tuple(r) for r in plain.edges.collect()] == [("g", 0, 399)] and plain.vertices.count() == 2
        assert networks.largest_component(graphs).edges.count() == 399
    finally:
        spark.conf.unset(limit)
