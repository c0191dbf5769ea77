"""All graph queries by name, with the SQL that gives the same rows.

Results are integers wherever two engines may differ in the last bit of a float.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.kernels import hull_area
from ..operators import forward, networks, reports, rules, signals
from ..operators.graphs import Graphs
from ..operators.mining import Settings, alike, detect, frequency_cut, groups_of, pattern_seed
from ..operators.parsing import parse, reconstruct
from ..sources import generators, readers, writers
from . import inputs, path_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Tolerance of the queries over event series, which are far from any regular shape.
LOOSE = 0.5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def micro(c: Column, unit: float = 1e6) -> Column:
    """Nearest whole number of units, halves up; the same arithmetic as in the SQL."""
    return F.floor(c * unit + 0.5).cast("long")


_SERIES = "s AS (SELECT CAST(user_id AS VARCHAR) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events WHERE value IS NOT NULL)"


def _path(tau: int = 1) -> str:
    """SQL: s, the vertices p(g, v, x, y) of all trajectories, and their edges e(g, u, w)."""
    return f"""{_SERIES}, q AS (SELECT g, i, x, lead(x, {tau}) OVER (PARTITION BY g ORDER BY i) AS y FROM s),
p AS (SELECT g, i AS v, x, y FROM q WHERE y IS NOT NULL),
e AS (SELECT * FROM (SELECT g, v AS u, lead(v) OVER (PARTITION BY g ORDER BY v) AS w FROM p) WHERE w IS NOT NULL)"""


_EMBED = """p AS (SELECT CAST(label AS VARCHAR) AS g, vec_id AS v, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
e AS (SELECT * FROM (SELECT g, v AS u, lead(v) OVER (PARTITION BY g ORDER BY v) AS w FROM p) WHERE w IS NOT NULL)"""
_SUPPLY = "e AS (SELECT DISTINCT -l_suppkey - 1 AS u, l_partkey AS w FROM lineitem)"
_HALF_EVEN = path_sql.HALF_EVEN


# ---- series and trajectories


@query(f"WITH {_path(3)} SELECT g AS series_id, v AS i, x AS px, y AS py FROM p")
def phase_space_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.phase_space(inputs.series(spark, sf_dir), 3, normalize=False)


@query(f"""WITH {_path(3)} SELECT g AS series_id, v AS i,
 CAST(floor((x - avg(x) OVER (PARTITION BY g)) / (stddev_pop(x) OVER (PARTITION BY g) + 1e-12) * 1e4::DOUBLE + 0.5) AS BIGINT) AS px,
 CAST(floor((y - avg(y) OVER (PARTITION BY g)) / (stddev_pop(y) OVER (PARTITION BY g) + 1e-12) * 1e4::DOUBLE + 0.5) AS BIGINT) AS py FROM p""")
def phase_space_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = signals.phase_space(inputs.series(spark, sf_dir), 3)
    return points.select("series_id", "i", micro(F.col("px"), 1e4).alias("px"), micro(F.col("py"), 1e4).alias("py"))


@query(f"WITH {_path()}, t AS (SELECT g, v - 5 AS v, x, y FROM p WHERE v >= 5 AND v < 35) SELECT g AS graph_id, v, x, y FROM t")
def trajectory_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = signals.phase_space(inputs.series(spark, sf_dir), 1, normalize=False)
    return signals.trajectory(points, 5, 30).vertices


@query(f"WITH {_path()} SELECT g AS graph_id, u, w FROM e")
def trajectory_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.trajectories(spark, sf_dir).edges


@query(f"""WITH {_SERIES}, d AS (SELECT g, i, x - avg(x) OVER (PARTITION BY g) AS d, count(*) OVER (PARTITION BY g) AS n FROM s),
r AS (SELECT a.g, b.i - a.i AS lag, sum(a.d * b.d) AS r FROM d a JOIN d b ON a.g = b.g AND b.i > a.i AND b.i - a.i < least(100, a.n - 1) GROUP BY 1, 2),
f AS (SELECT g, min(lag) AS tau FROM r WHERE r <= 0 GROUP BY 1)
SELECT DISTINCT s.g AS series_id, CAST(coalesce(tau, 25) AS INTEGER) AS tau FROM s LEFT JOIN f USING (g)""")
def autocorr_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.estimate_tau(inputs.series(spark, sf_dir))


def _filtered(fs: float, low: float, high: float) -> str:
    """SQL: s and b(g, i, x, n), the series of s without the frequencies outside low..high, by sums of sines and cosines."""
    return f"""{_SERIES}, n AS (SELECT g, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT g, n, k, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS weight FROM n, range(100000) AS t(k) WHERE 2 * k <= n AND k * (1 / (n * (1 / {fs!r}::DOUBLE))) >= {low!r}::DOUBLE AND k * (1 / (n * (1 / {fs!r}::DOUBLE))) <= {high!r}::DOUBLE),
c AS (SELECT s.g, k.k, any_value(k.n) AS n, any_value(weight) AS weight, sum(x * cos(2 * pi() * ((k.k * i) % k.n) / k.n)) AS re, sum(x * sin(2 * pi() * ((k.k * i) % k.n) / k.n)) AS im FROM s JOIN k ON s.g = k.g GROUP BY 1, 2),
b AS (SELECT s.g, s.i, any_value(n.n) AS n, coalesce(sum(weight * (re * cos(2 * pi() * ((k * i) % c.n) / c.n) + im * sin(2 * pi() * ((k * i) % c.n) / c.n))), 0) / any_value(n.n) AS x FROM s JOIN n ON s.g = n.g LEFT JOIN c ON c.g = s.g GROUP BY 1, 2)"""


@query(f"WITH {_filtered(160.0, 4.0, 30.0)} SELECT g AS series_id, i, CAST(floor(x * 1e4::DOUBLE + 0.5) AS BIGINT) AS x FROM b")
def bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.bandpass(inputs.series(spark, sf_dir), 160.0, 4.0, 30.0).select("series_id", "i", micro(F.col("x"), 1e4).alias("x"))


@query(f"""WITH {_filtered(160.0, 0.0, 60.0)}, d AS (SELECT g, i, n, x - avg(x) OVER (PARTITION BY g) AS d FROM b),
r AS (SELECT a.g, z.i - a.i AS lag, sum(a.d * z.d) AS r FROM d a JOIN d z ON a.g = z.g AND z.i > a.i AND z.i - a.i < least(100, a.n - 1) GROUP BY 1, 2),
t AS (SELECT n.g, n.n, coalesce(min(CASE WHEN r <= 0 THEN lag END), 25) AS tau FROM n LEFT JOIN r ON n.g = r.g GROUP BY 1, 2)
SELECT g AS graph_id, u, u + 1 AS w FROM (SELECT g, unnest(range(n - tau - 1)) AS u FROM t WHERE n - tau > 1)""")
def signal_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.signal_graph(inputs.series(spark, sf_dir), 160.0, count=None, band=(0.0, 60.0))[0].edges


# ---- graph model


@query(f"WITH {_SUPPLY}, d AS (SELECT u AS v FROM e UNION ALL SELECT w FROM e), c AS (SELECT v, count(*) AS n FROM d GROUP BY 1), a AS (SELECT -s_suppkey - 1 AS v FROM supplier UNION ALL SELECT p_partkey FROM part) SELECT coalesce(n, 0) AS degree, count(*) AS vertices FROM a LEFT JOIN c USING (v) GROUP BY 1")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.supply_graph(spark, sf_dir).degrees().groupBy("degree").agg(F.count("*").alias("vertices"))


@query(f"WITH {_path()} SELECT g AS graph_id, u AS v, w AS nb FROM e UNION ALL SELECT g, w, u FROM e")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.trajectories(spark, sf_dir).adjacency()


@query(f"WITH {_SUPPLY} SELECT u, w FROM e WHERE u % 2 = 0 AND w % 3 = 0")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = inputs.supply_graph(spark, sf_dir)
    chosen = graphs.vertices.where("(v < 0 AND v % 2 = 0) OR (v >= 0 AND v % 3 = 0)")
    return graphs.induced(chosen).edges.select("u", "w")


@query(f"WITH {_path()} SELECT g AS graph_id, u, w FROM e WHERE u % 10 <> 0 AND w % 10 <> 0")
def vertex_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = inputs.trajectories(spark, sf_dir)
    return graphs.without(graphs.vertices.where("v % 10 = 0")).edges


@query(f"WITH {_path()}, t AS (SELECT g, a, a + 2 * (a % 2) - 1 AS b FROM (SELECT g, v AS a FROM p)) SELECT t.g AS graph_id, a, b, e.u IS NOT NULL AS there FROM t LEFT JOIN e ON t.g = e.g AND e.u = least(a, b) AND e.w = greatest(a, b)")
def edge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graphs import has_edges

    graphs = inputs.trajectories(spark, sf_dir)
    return has_edges(graphs, graphs.vertices.select("graph_id", F.col("v").alias("a"), (F.col("v") + 2 * (F.col("v") % 2) - 1).alias("b")))


@query(f"WITH {_path()} SELECT g AS graph_id, max(v) + 1 AS fresh FROM p GROUP BY 1")
def fresh_vertex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.trajectories(spark, sf_dir).fresh_ids()


@query(f"WITH {_EMBED} SELECT g AS graph_id, CAST(floor(avg(x) * 1e6::DOUBLE + 0.5) AS BIGINT) AS cx, CAST(floor(avg(y) * 1e6::DOUBLE + 0.5) AS BIGINT) AS cy FROM p GROUP BY 1")
def centroid_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = inputs.embedding_paths(spark, sf_dir).vertices
    return v.groupBy("graph_id").agg(micro(F.avg("x")).alias("cx"), micro(F.avg("y")).alias("cy"))


@query(f"WITH {_path()} SELECT g AS graph_id, v - v % 3 AS node, count(*) AS members FROM p GROUP BY 1, 2 HAVING count(*) > 0")
def quotient_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = inputs.trajectories(spark, sf_dir)
    return graphs.vertices.groupBy("graph_id", (F.col("v") - F.col("v") % 3).alias("node")).agg(F.count("*").alias("members"))


@query(f"WITH {_path()} SELECT DISTINCT g AS graph_id, u - u % 3 AS u, w - w % 3 AS w FROM e WHERE u - u % 3 <> w - w % 3")
def quotient_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = inputs.trajectories(spark, sf_dir)
    node = (F.col("v") - F.col("v") % 3).alias("node")
    mapping = graphs.vertices.select("graph_id", "v", node)
    places = graphs.vertices.groupBy("graph_id", node).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumnRenamed("node", "v")
    return graphs.contract(mapping, places).edges


# ---- geometry


_T = "(SELECT p_partkey AS k, 1.0::DOUBLE + p_size / 10.0::DOUBLE AS s, p_retailprice / 1000.0::DOUBLE AS t FROM part)"


def _transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    s, t = 1.0 + F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0
    return part.select("p_partkey", G.similarity(s, -t, t, s, t, s).alias("t"))


@query(f"SELECT k AS p_partkey, CAST(floor((s * 2 - t * 3 + t) * 1e6::DOUBLE + 0.5) AS BIGINT) AS x, CAST(floor((t * 2 + s * 3 + s) * 1e6::DOUBLE + 0.5) AS BIGINT) AS y FROM {_T}")
def similarity_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, x, y = F.col("t"), F.lit(2.0), F.lit(3.0)
    return _transforms(spark, sf_dir).select("p_partkey", micro(G.apply_x(t, x, y)).alias("x"), micro(G.apply_y(t, x, y)).alias("y"))


@query(f"SELECT k AS p_partkey, CAST(floor((s * s - t * t) * 1e6::DOUBLE + 0.5) AS BIGINT) AS a00, CAST(floor(2 * s * t * 1e6::DOUBLE + 0.5) AS BIGINT) AS a10, CAST(floor((s * t - t * s + t) * 1e6::DOUBLE + 0.5) AS BIGINT) AS b0 FROM {_T}")
def similarity_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.compose(F.col("t"), F.col("t"))
    return _transforms(spark, sf_dir).select("p_partkey", c.alias("c")).select("p_partkey", micro(F.col("c.a00")).alias("a00"), micro(F.col("c.a10")).alias("a10"), micro(F.col("c.b0")).alias("b0"))


@query(f"SELECT k AS p_partkey, CAST(floor(s / (s * s + t * t) * 1e6::DOUBLE + 0.5) AS BIGINT) AS a00, CAST(floor(sqrt(s * s + t * t) * 1e6::DOUBLE + 0.5) AS BIGINT) AS scale, TRUE AS proper, 0 AS drift FROM {_T}")
def similarity_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, i = F.col("t"), G.inverse(F.col("t"))
    drift = F.abs(G.apply_x(t, G.apply_x(i, F.lit(4.0), F.lit(5.0)), G.apply_y(i, F.lit(4.0), F.lit(5.0))) - 4.0)
    return _transforms(spark, sf_dir).select("p_partkey", micro(i["a00"]).alias("a00"), micro(G.scale_of(t)).alias("scale"), G.keeps_orientation(t).alias("proper"), F.floor(drift * 1e6).cast("int").alias("drift"))


_FIT_SQL = f"""WITH {_EMBED}, q AS (SELECT g, x, y, lead(x) OVER o AS u, lead(y) OVER o AS w FROM p WINDOW o AS (PARTITION BY g ORDER BY v)),
m AS (SELECT *, x - avg(x) OVER b AS cx, y - avg(y) OVER b AS cy, u - avg(u) OVER b AS cu, w - avg(w) OVER b AS cw FROM q WHERE u IS NOT NULL WINDOW b AS (PARTITION BY g)),
a AS (SELECT g, sum(cx * cu + cy * cw) AS c, sum(cx * cw - cy * cu) AS s, sum(cx * cx + cy * cy) AS v FROM m GROUP BY 1)
SELECT g AS graph_id, CAST(floor(c / v * 1e6::DOUBLE + 0.5) AS BIGINT) AS a00, CAST(floor(s / v * 1e6::DOUBLE + 0.5) AS BIGINT) AS a10 FROM a"""


@query(_FIT_SQL)
def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best proper similarity from each point of a path to the next one, by sums alone."""
    v = inputs.embedding_paths(spark, sf_dir).vertices
    by, order = Window.partitionBy("graph_id"), Window.partitionBy("graph_id").orderBy("v")
    pairs = v.select("*", F.lead("x").over(order).alias("u"), F.lead("y").over(order).alias("w")).where("u IS NOT NULL")
    m = pairs.select("graph_id", *[(F.col(c) - F.avg(c).over(by)).alias(c) for c in ("x", "y", "u", "w")])
    sums = m.groupBy("graph_id").agg(F.sum(F.expr("x * u + y * w")).alias("c"), F.sum(F.expr("x * w - y * u")).alias("s"), F.sum(F.expr("x * x + y * y")).alias("q"))
    return sums.select("graph_id", micro(F.col("c") / F.col("q")).alias("a00"), micro(F.col("s") / F.col("q")).alias("a10"))


@query(f"""WITH {_path()}, h AS (SELECT DISTINCT g, x, y FROM p),
side AS (SELECT a.g, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM h a JOIN h b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.g = a.g AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - b.x) * (a.x - b.x) + (c.y - b.y) * (a.y - b.y) < 0)))),
area AS (SELECT g, sum(px * qy - py * qx) / 2 AS area FROM side GROUP BY 1)
SELECT DISTINCT h.g AS graph_id, CAST(floor(coalesce(area, 0) * 100 + 0.5) AS BIGINT) AS area FROM h LEFT JOIN area USING (g)""")
def convex_hull_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas in hundredths; the SQL finds a hull's sides as the pairs that have no point on their right."""
    import pandas as pd

    def run(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"graph_id": [df["graph_id"].iloc[0]], "area": [hull_area(df[["x", "y"]].to_numpy())]})

    areas = inputs.trajectories(spark, sf_dir).vertices.select("graph_id", "x", "y").groupBy("graph_id").applyInPandas(run, "graph_id string, area double")
    return areas.select("graph_id", micro(F.col("area"), 100.0).alias("area"))


@query(f"""WITH {_path()}, t AS (SELECT a.g, a.v, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, c.x - a.x AS ex, c.y - a.y AS ey FROM p a JOIN p b ON a.g = b.g AND b.v = a.v + 1 JOIN p c ON a.g = c.g AND c.v = a.v + 2),
z AS (SELECT (dx / (dx * dx + dy * dy)) * ex + (dy / (dx * dx + dy * dy)) * ey AS x, (dx / (dx * dx + dy * dy)) * ey - (dy / (dx * dx + dy * dy)) * ex AS y FROM t),
r AS (SELECT sqrt(x * x + y * y) AS r, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS a FROM z)
SELECT CAST(least(floor(a / (2 * pi()) * 10), 9) AS INTEGER) AS ai, CAST(least(floor(r / 3 * 12), 11) AS INTEGER) AS di, count(*) AS n FROM r WHERE r >= 1e-12 AND r <= 3 GROUP BY 1, 2""")
def polar_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the next point lies in the frame of each trajectory step, counted by polar cells."""
    a = _triples(inputs.trajectories(spark, sf_dir))
    t = G.frame_of_edge(F.lit(0.0), F.lit(0.0), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    x, y = F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    cell = a.select(t.alias("t"), x.alias("x"), y.alias("y")).select(G.polar_cell(G.apply_x(F.col("t"), F.col("x"), F.col("y")), G.apply_y(F.col("t"), F.col("x"), F.col("y"))).alias("c"))
    return cell.where("c IS NOT NULL").groupBy(F.col("c.ai").alias("ai"), F.col("c.di").alias("di")).agg(F.count("*").alias("n"))


# ---- shapes


def _triples(graphs: Graphs) -> DataFrame:
    """graph_id, a and the places of every three consecutive vertices of a path."""
    o = Window.partitionBy("graph_id").orderBy("v")
    at = lambda c, k, n: F.lead(c, k).over(o).alias(n)
    rows = graphs.vertices.select("graph_id", F.col("v").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), at("x", 1, "bx"), at("y", 1, "by"), at("x", 2, "cx"), at("y", 2, "cy"))
    return rows.where("cx IS NOT NULL")


def triple_keys(graphs: Graphs, quant: float) -> DataFrame:
    """graph_id, a, key: the canonical key of the path a, a + 1, a + 2, all in Column functions.

    Both directions of both edges give a frame; in each the three cells are sorted, and the least list is the key. The
    path's edges follow from its middle vertex, which comes first in the key's last part.
    """
    frames = [("a", "b", "c"), ("b", "a", "c"), ("b", "c", "a"), ("c", "b", "a")]
    views = []
    for p, q, r in frames:
        dx, dy = F.col(f"{q}x") - F.col(f"{p}x"), F.col(f"{q}y") - F.col(f"{p}y")
        n = dx * dx + dy * dy
        ex, ey = F.col(f"{r}x") - F.col(f"{p}x"), F.col(f"{r}y") - F.col(f"{p}y")
        cell = lambda v: F.rint(v / quant).cast("long")
        third = F.array(cell((ex * dx + ey * dy) / n), cell((ey * dx - ex * dy) / n))
        origin, unit = F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), F.array(F.lit(round(1 / quant)).cast("long"), F.lit(0).cast("long"))
        views.append(F.array_sort(F.array(origin, unit, third)))
    rows = _triples(graphs)
    return rows.select("graph_id", "a", F.array_join(F.transform(F.array_min(F.array(*views)), lambda c: F.concat_ws(" ", c[0], c[1])), ";").alias("key"))


def _triple_sql() -> str:
    """SQL: k(g, a, key) as triple_keys with quant 0.5."""

    def view(p, q, r):
        dx, dy, ex, ey = f"({q}_x - {p}_x)", f"({q}_y - {p}_y)", f"({r}_x - {p}_x)", f"({r}_y - {p}_y)"
        n = f"({dx} * {dx} + {dy} * {dy})"
        c = [f"CAST({_HALF_EVEN.format(x=f'(({v}) / {n} / 0.5::DOUBLE)')} AS BIGINT)" for v in (f"{ex} * {dx} + {ey} * {dy}", f"{ey} * {dx} - {ex} * {dy}")]
        return f"list_sort([[0::BIGINT, 0::BIGINT], [2::BIGINT, 0::BIGINT], [{c[0]}, {c[1]}]])"

    views = ", ".join(view(*f) for f in (("a", "b", "c"), ("b", "a", "c"), ("b", "c", "a"), ("c", "b", "a")))
    return f"""{_path()}, t AS (SELECT a.g, a.v AS a, a.x AS a_x, a.y AS a_y, b.x AS b_x, b.y AS b_y, c.x AS c_x, c.y AS c_y FROM p a JOIN p b ON a.g = b.g AND b.v = a.v + 1 JOIN p c ON a.g = c.g AND c.v = a.v + 2),
m AS (SELECT g, a, list_sort([{views}])[1] AS l FROM t),
k AS (SELECT g, a, array_to_string(list_transform(l, lambda z: array_to_string(z, ' ')), ';') AS key FROM m)"""


def key_text(key: Column) -> Column:
    """Cells and links of a canonical key as text."""
    pair = lambda a, b: lambda z: F.concat_ws(" ", z[a], z[b])
    return F.concat_ws("|", F.array_join(F.transform(key["q"], pair("qx", "qy")), ";"), F.array_join(F.transform(key["e"], pair("i", "j")), ";"))


@query(f"WITH {_path()}, {path_sql.places()}, t AS (SELECT g, unnest(range(n - 2)) AS a FROM n WHERE n > 2), {path_sql.forms(3, 't', LOOSE)} SELECT g AS graph_id, a, {path_sql.KEY_TEXT} AS key FROM f3")
def triple_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical key of every three consecutive vertices, as start shapes of a user's choice."""
    graphs = inputs.trajectories(spark, sf_dir)
    runs = _triples(graphs).select("graph_id", F.col("a").alias("pos"), F.sequence(F.col("a"), F.col("a") + 2).alias("occ"))
    return pattern_seed(graphs, runs, _shapes()).select("graph_id", F.col("occ")[0].alias("a"), key_text(F.col("key")).alias("key"))


@query(f"WITH {_path()}, {path_sql.mined(3, LOOSE)} SELECT {path_sql.KEY_TEXT} AS key, count(*) AS frequency, 2 * count(*) AS gain FROM found WHERE ord = 3 GROUP BY 1")
def isogroup_frequency_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: how often each shape of three vertices repeats within trajectories, up to rotation, scale and shift."""
    found = detect(inputs.trajectories(spark, sf_dir), Settings(quant=LOOSE, max_order=3)).where("ord = 3")
    groups = found.groupBy(key_text(F.col("key")).alias("key")).agg(F.count("*").alias("frequency"))
    return groups.select("key", "frequency", (2 * F.col("frequency")).alias("gain"))


@query(f"""WITH {_triple_sql()}, f AS (SELECT g, key, count(*) AS frequency FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY frequency DESC, key) AS rank, count(*) OVER (PARTITION BY g) AS n FROM f),
b AS (SELECT *, n * (1.0::DOUBLE - 0.8::DOUBLE) AS x FROM r)
SELECT g AS graph_id, key, frequency, rank FROM b WHERE rank <= greatest(1, {_HALF_EVEN.format(x='x')}) OR n = 1""")
def frequency_cut_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = triple_keys(inputs.trajectories(spark, sf_dir), LOOSE)
    groups = keys.groupBy("graph_id", "key").agg(F.count("*").alias("frequency")).withColumn("ord", F.lit(3))
    return frequency_cut(groups, 0.8).select("graph_id", "key", "frequency", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_triple_sql()} SELECT l.g AS graph_id, l.a, r.a AS b FROM k l JOIN k r ON l.g = r.g AND l.key = r.key AND r.a > l.a AND r.a <= l.a + 2")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = triple_keys(inputs.trajectories(spark, sf_dir), LOOSE)
    occurrences = keys.select("graph_id", F.xxhash64("key").alias("grp"), F.col("a").alias("pos"), F.sequence(F.col("a"), F.col("a") + 2).alias("occ"))
    return rules.overlap_pairs(occurrences).select("graph_id", "a", "b")


@query(f"WITH {_path()}, a AS (SELECT g, u AS v, w AS nb FROM e UNION ALL SELECT g, w, u FROM e) SELECT DISTINCT e.g AS graph_id, e.u, e.w, a.nb AS candidate FROM e JOIN a ON e.g = a.g AND a.v IN (e.u, e.w) WHERE a.nb NOT IN (e.u, e.w)")
def candidate_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = inputs.trajectories(spark, sf_dir)
    flat = graphs.edges.select("graph_id", "u", "w", F.explode(F.array("u", "w")).alias("v")).join(graphs.adjacency(), ["graph_id", "v"])
    return flat.where("nb <> u AND nb <> w").select("graph_id", "u", "w", F.col("nb").alias("candidate")).distinct()


# ---- networks


@query(f"""WITH {_EMBED}, l AS (SELECT e.g, e.u, e.w, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM e JOIN p a ON a.g = e.g AND a.v = e.u JOIN p b ON b.g = e.g AND b.v = e.w),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM l), m AS (SELECT g, d AS median FROM r WHERE k = n // 2)
SELECT l.g AS graph_id, u, w FROM l JOIN m USING (g) WHERE d <= 1.5::DOUBLE * median""")
def edge_length_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.trim_long_edges(inputs.embedding_paths(spark, sf_dir), 1.5).edges


_CUT = f"{_path()}, c AS (SELECT a.g, a.v, CASE WHEN b.v IS NULL OR abs(a.x - b.x) > 120 THEN a.v END AS head FROM p a LEFT JOIN p b ON a.g = b.g AND b.v = a.v - 1), l AS (SELECT g, v, max(head) OVER (PARTITION BY g ORDER BY v) AS component FROM c)"


def _cut_paths(spark: SparkSession, sf_dir: str) -> Graphs:
    """Trajectories without their jumps of more than 120."""
    graphs = inputs.trajectories(spark, sf_dir)
    place = lambda c: graphs.vertices.select("graph_id", F.col("v").alias(c), F.col("x").alias(f"{c}x"))
    near = graphs.edges.join(place("u"), ["graph_id", "u"]).join(place("w"), ["graph_id", "w"]).where("abs(ux - wx) <= 120")
    return Graphs(graphs.vertices, near.select("graph_id", "u", "w"))


@query(f"WITH {_CUT} SELECT g AS graph_id, v, component FROM l")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.component_labels(_cut_paths(spark, sf_dir))


@query(f"WITH {_CUT}, n AS (SELECT g, component, count(*) AS n FROM l GROUP BY 1, 2), b AS (SELECT g, component, row_number() OVER (PARTITION BY g ORDER BY n DESC, component) AS r FROM n) SELECT l.g AS graph_id, v FROM l JOIN b USING (g, component) WHERE r = 1")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.largest_component(_cut_paths(spark, sf_dir)).vertices.select("graph_id", "v")


@query(f"WITH {_path()} SELECT g AS graph_id, min(v) AS u, max(v) AS w FROM p GROUP BY 1 HAVING count(*) > 1")
def simplify_degree2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.simplify_degree2(inputs.trajectories(spark, sf_dir)).edges


@query("""WITH n AS (SELECT c_custkey AS v, c_acctbal / 1000.0::DOUBLE AS lat, c_nationkey * 1.0::DOUBLE AS lon FROM customer), m AS (SELECT avg(lat) AS lat0, avg(lon) AS lon0 FROM n),
u AS (SELECT v, o FROM (SELECT o_custkey AS v, o_orderkey AS o FROM orders) WHERE v IN (SELECT v FROM n)), w AS (SELECT DISTINCT v FROM n WHERE v % 7 < 5)
SELECT v, CAST(floor(6371000.0::DOUBLE * radians(lon - lon0) * cos(radians(lat0)) / 10 + 0.5) AS BIGINT) AS x, CAST(floor(6371000.0::DOUBLE * radians(lat - lat0) / 10 + 0.5) AS BIGINT) AS y FROM n, m WHERE v IN (SELECT v FROM w)
AND (v % 7 < 4 AND v + 1 IN (SELECT v FROM n) OR v % 7 > 0 AND v - 1 IN (SELECT v FROM n))""")
def osm_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as map nodes; a way runs through every five of seven consecutive keys."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nodes = c.select(F.lit("map").alias("graph_id"), F.lit("node").alias("type"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000.0).alias("lat"), F.col("c_nationkey").cast("double").alias("lon"), F.lit(None).cast("array<bigint>").alias("nodes"))
    start = (F.col("c_custkey") - F.col("c_custkey") % 7).alias("id")
    ways = c.select(start).distinct().select(F.lit("map").alias("graph_id"), F.lit("way").alias("type"), "id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.sequence(F.col("id"), F.col("id") + 4).alias("nodes"))
    v = readers.street_graph(nodes.unionByName(ways), simplify=False).vertices
    return v.select("v", micro(F.col("x") / 10, 1.0).alias("x"), micro(F.col("y") / 10, 1.0).alias("y"))


# ---- generators


@query("SELECT i AS v, CAST(i % 40 AS DOUBLE) * 2 AS x, CAST(i // 40 AS DOUBLE) * 2 AS y FROM range(1200) AS t(i)")
def lattice_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.lattice(spark, 30, 40, 2.0).vertices.select("v", "x", "y")


@query("SELECT i AS u, i + 1 AS w FROM range(1200) AS t(i) WHERE i % 40 < 39 UNION ALL SELECT i, i + 40 FROM range(1200) AS t(i) WHERE i < 1160")
def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.lattice(spark, 30, 40, 2.0).edges.select("u", "w")


@query("""WITH RECURSIVE m(path, s, x, y) AS (SELECT '', 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
SELECT path || c.k, s / 2, x + s * c.dx, y + s * c.dy FROM m, (VALUES ('0', 0.0::DOUBLE, 0.0::DOUBLE), ('1', 0.5::DOUBLE, 0.0::DOUBLE), ('2', 0.25::DOUBLE, sqrt(3::DOUBLE) / 4)) AS c(k, dx, dy) WHERE length(path) < 5)
SELECT path, CAST(floor(s * 1e6::DOUBLE + 0.5) AS BIGINT) AS scale, CAST(floor(x * 1e6::DOUBLE + 0.5) AS BIGINT) AS x, CAST(floor(y * 1e6::DOUBLE + 0.5) AS BIGINT) AS y FROM m WHERE length(path) = 5""")
def sierpinski_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = forward.derive(forward.sierpinski(spark), 5)
    return m.select(F.array_join("path", "").alias("path"), micro(F.col("frame.a00")).alias("scale"), micro(F.col("frame.b0")).alias("x"), micro(F.col("frame.b1")).alias("y"))


@query("SELECT 366 AS n_vertices, 729 AS n_edges")
def sierpinski_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = forward.generate(forward.sierpinski(spark), 5).sizes()
    return sizes.select(F.col("n_vertices").cast("int").alias("n_vertices"), F.col("n_edges").cast("int").alias("n_edges"))


@query()
def jittered_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.jitter(generators.lattice(spark, 30, 40), 0.05).vertices


@query()
def synthetic_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.synthetic_signal(spark)


# ---- mining, learning, recognition


def _shapes() -> Settings:
    return Settings(quant=LOOSE)


#: What the defaults of mining find on the paths of each table.
_MINED_TRAJECTORIES = f"WITH {_path()}, {path_sql.mined(Settings().max_order, LOOSE)}, c AS (SELECT g, ord, count(*) AS frequency FROM found GROUP BY g, ord, q, links)"
_MINED_EMBEDDINGS = f"WITH {_EMBED}, {path_sql.mined(Settings().max_order, LOOSE)}, c AS (SELECT g, ord, count(*) AS frequency FROM found GROUP BY g, ord, q, links)"


@query(f"{_MINED_TRAJECTORIES} SELECT g AS graph_id, ord, frequency, frequency * (ord - 1) AS gain FROM c")
def detect_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_of(detect(inputs.trajectories(spark, sf_dir), _shapes())).select("graph_id", "ord", "frequency", "gain")


@query(f"{_MINED_EMBEDDINGS} SELECT g AS graph_id, ord, count(*) AS groups, max(frequency) AS max_frequency FROM c GROUP BY 1, 2")
def order_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.order_histogram(detect(inputs.embedding_paths(spark, sf_dir), _shapes()))


@query(f"{_MINED_EMBEDDINGS} SELECT g AS graph_id, ord, frequency FROM c WHERE frequency >= 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY ord DESC, frequency DESC) = 1")
def select_isogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.select_group(groups_of(detect(inputs.embedding_paths(spark, sf_dir), _shapes()))).select("graph_id", "ord", "frequency")


@query()
def best_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.best_rules(detect(inputs.embedding_paths(spark, sf_dir), _shapes())).select("graph_id", "k", "occ", "frequency")


@query()
def learn_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.learn(inputs.embedding_paths(spark, sf_dir), _shapes()).rules.select("graph_id", "rule_id", "level", "frequency", F.size("rhs_vertices").alias("ord"))


def _learned(spark: SparkSession, sf_dir: str) -> tuple[Graphs, rules.Grammar]:
    """The whole paths of all labels, and the rules of all levels that each of them gives."""
    graphs = inputs.embedding_paths(spark, sf_dir)
    return graphs, rules.learn(graphs, _shapes())


@query()
def grammar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.grammar_stats(*_learned(spark, sf_dir))


@query()
def parse_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(*_learned(spark, sf_dir), quant=LOOSE).steps


@query(f"WITH {_EMBED} SELECT g AS graph_id, u, w FROM e")
def reconstruct_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges again, from the paths that the learned rules reduced and the log of the reductions."""
    return reconstruct(parse(*_learned(spark, sf_dir), quant=LOOSE)).edges.select("graph_id", "u", "w")


@query(f"WITH {_path()} SELECT g AS graph_id, u, w, CASE WHEN u // 4 % 5 = w // 4 % 5 THEN u // 4 % 5 ELSE -1 END AS colour FROM e")
def coloured_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a drawing of trajectories with vertices coloured by fours needs."""
    graphs = inputs.trajectories(spark, sf_dir)
    drawn = writers.coloured_edges(graphs, graphs.vertices.select("graph_id", "v", (F.floor(F.col("v") / 4) % 5).alias("colour")))
    return drawn.na.fill(-1, ["colour"])


@query("SELECT 'lattice' AS a, 'large' AS b")
def alike_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole graphs of one shape: a lattice and its enlarged copy, but not a wider one."""
    other, wide = generators.lattice(spark, 2, 3, 2.5, "large"), generators.lattice(spark, 2, 4, 1.0, "wide")
    return alike(generators.lattice(spark, 2, 3), Graphs(other.vertices.unionByName(wide.vertices), other.edges.unionByName(wide.edges)))
