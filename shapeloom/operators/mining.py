"""Mining of repeated shapes: grow every occurrence by one vertex, name children by their canonical key, keep frequent ones.

An occurrence is a row (graph_id, ord, key, grp, pos, occ, pattern_edges). The order of occurrences matters: pos rises
with it, and grp is the least pos of the occurrence's group, so a group's pattern is its row with pos = grp. Neither needs to
be dense, so both come from one distributed sort and no task sees a whole group.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import EPS, Forms, Grid, added_areas, canonical, canonical_batch, framed, moved
from ..sources.scratch import stash
from .graphs import Graphs

KEY = "struct<q:array<struct<qx:int,qy:int>>,e:array<struct<i:int,j:int>>>"
OCCURRENCE = f"graph_id string, ord int, key {KEY}, grp long, pos long, occ array<long>, n_edges int"


@dataclass(frozen=True)
class Settings:
    """grid and quant fix what counts as alike; min_frequency and frequency_cut what is kept; max_order where growth ends."""

    quant: float = 0.05
    min_frequency: int = 2
    max_order: int | None = 6
    frequency_cut: float = 0.0
    grid: Grid = field(default_factory=Grid)


def key_struct(key: tuple) -> dict:
    cells, links = key
    return {"q": [{"qx": x, "qy": y} for x, y in cells], "e": [{"i": i, "j": j} for i, j in links]}


def in_context(occurrences: DataFrame, graphs: Graphs, *carry: str) -> DataFrame:
    """Each occurrence with `context`: its vertices, their places and neighbours, by id."""
    flat = occurrences.select("graph_id", "pos", *carry, F.explode("occ").alias("v")).join(graphs.surroundings(), ["graph_id", "v"])
    # A context is small and its work in Python is not, so contexts are dealt over a fixed number of tasks.
    flat = flat.repartition(int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions")), "graph_id", "pos")
    return flat.groupBy("graph_id", "pos", *carry).agg(F.array_sort(F.collect_list(F.struct("v", "x", "y", "around"))).alias("context"))


class Local:
    """An occurrence's own part of its graph, from its context."""

    def __init__(self, context):
        self.ids = [int(c["v"]) for c in context]
        self.place = {int(c["v"]): (c["x"], c["y"]) for c in context}
        self.around = {int(c["v"]): [int(n["v"]) for n in c["around"]] for c in context}
        inside = set(self.ids)
        self.edges = [(v, n) for v in self.ids for n in self.around[v] if n in inside and v < n]
        self.outside = {int(n["v"]): (n["x"], n["y"]) for c in context for n in c["around"] if int(n["v"]) not in inside}
        self.points = np.array([self.place[v] for v in self.ids])

    def form(self, quant: float):
        return canonical(self.ids, self.points, self.edges, quant)


class Contexts:
    """A batch of occurrences of one size from their contexts (a list column), as arrays.

    ids (B, n) ascend, points (B, n, 2), linked (B, n, n). The vertices next to an occurrence, by occurrence and id: owner (K),
    extra (K), places (K, 2) and ties (K, n), which tells their links.
    """

    def __init__(self, context: pa.Array):
        flat = context.flatten()
        size, n = len(context), len(flat) // len(context)
        number = lambda rows, name: rows.field(name).to_numpy(zero_copy_only=False)
        self.ids = number(flat, "v").reshape(size, n)
        self.points = np.stack([number(flat, "x"), number(flat, "y")], axis=1).reshape(size, n, 2)
        around = flat.field("around")
        near = around.flatten()
        owner, vertex = np.divmod(np.repeat(np.arange(size * n), pc.list_value_length(around).to_numpy(zero_copy_only=False)), n)
        ids, places = number(near, "v"), np.stack([number(near, "x"), number(near, "y")], axis=1)
        same = self.ids[owner] == ids[:, None]
        inside = same.any(axis=1)
        self.linked = np.zeros((size, n, n), bool)
        self.linked[owner[inside], vertex[inside], same[inside].argmax(axis=1)] = True
        owner, vertex, ids, places = owner[~inside], vertex[~inside], ids[~inside], places[~inside]
        by = np.lexsort((ids, owner))
        owner, vertex, ids, places = owner[by], vertex[by], ids[by], places[by]
        fresh = (np.diff(owner, prepend=-1) != 0) | (np.diff(ids, prepend=0) != 0)
        self.ties = np.zeros((int(fresh.sum()), n), bool)
        self.ties[np.cumsum(fresh) - 1, vertex] = True
        self.owner, self.extra, self.places = owner[fresh], ids[fresh], places[fresh]

    def shaped(self) -> np.ndarray:
        """Whether each has an edge of positive length, and so a form."""
        apart = self.points[:, :, None] - self.points[:, None]
        return (self.linked & (np.hypot(apart[..., 0], apart[..., 1]) >= EPS)).any(axis=(1, 2))

    def forms(self, quant: float) -> Forms:
        return canonical_batch(self.points, self.linked, quant)

    def grown(self, chosen: np.ndarray, quant: float) -> tuple[np.ndarray, Forms]:
        """Ids and forms of the occurrences with one more vertex each; chosen are places in extra, at least one."""
        owner, n = self.owner[chosen], self.ids.shape[1]
        ids = np.concatenate([self.ids[owner], self.extra[chosen, None]], axis=1)
        points = np.concatenate([self.points[owner], self.places[chosen, None]], axis=1)
        linked = np.zeros((len(chosen), n + 1, n + 1), bool)
        linked[:, :n, :n], linked[:, n, :n], linked[:, :n, n] = self.linked[owner], self.ties[chosen], self.ties[chosen]
        by, row = np.argsort(ids, axis=1), np.arange(len(chosen))[:, None]
        return ids[row, by], canonical_batch(points[row, by], linked[row[:, :, None], by[:, :, None], by[:, None, :]], quant)


def _by_size(batches):
    """The batches' rows, those with contexts of one size together."""
    for batch in batches:
        sizes = pc.list_value_length(batch["context"]).to_numpy(zero_copy_only=False)
        for n in np.unique(sizes):
            yield batch.filter(pa.array(sizes == n))


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def key_array(forms: Forms) -> pa.Array:
    """The keys as a column of type KEY."""
    small = lambda a: pa.array(np.ascontiguousarray(a)).cast(pa.int32())
    count, n = forms.cells.shape[:2]
    one, other = np.triu_indices(n, 1)
    pair = np.nonzero(forms.links)[1]
    cells = pa.StructArray.from_arrays([small(forms.cells[..., 0].reshape(-1)), small(forms.cells[..., 1].reshape(-1))], ["qx", "qy"])
    links = pa.StructArray.from_arrays([small(one[pair]), small(other[pair])], ["i", "j"])
    return pa.StructArray.from_arrays([_lists(cells, np.arange(1, count + 1) * n), _lists(links, np.cumsum(forms.links.sum(axis=1)))], ["q", "e"])


_GROWN = f"graph_id string, grp long, pos long, ai int, di int, child array<long>, key {KEY}, n_edges int, added array<double>"
_CHILD = ["graph_id", "grp", "pos", "ai", "di", "child", "key", "n_edges", "added"]


def _grow(settings: Settings):
    grid, quant = settings.grid, settings.quant
    centers = np.array([grid.center(a, d) for a in range(grid.n_angle) for d in range(grid.n_dist)])

    def run(batches):
        for batch in _by_size(batches):
            here = Contexts(batch["context"])
            forms = here.forms(quant)
            places = framed(forms.start[here.owner], forms.along[here.owner], here.places[:, None])[:, 0]
            within, ai, di = grid.cells(places)
            cell = (here.owner * grid.n_angle + ai) * grid.n_dist + di
            chosen = np.flatnonzero(within)
            chosen = chosen[np.unique(cell[chosen], return_index=True)[1]]  # ascending ids: the lowest of a cell stays
            if len(chosen):
                ids, grown = here.grown(chosen, quant)
                parent = batch.select(["graph_id", "grp", "pos"]).take(pa.array(here.owner[chosen]))
                children = _lists(pa.array(ids.reshape(-1)), np.arange(1, len(ids) + 1) * ids.shape[1])
                numbers = [pa.array(a, pa.int32()) for a in (ai[chosen], di[chosen], grown.links.sum(axis=1))]
                added = pa.nulls(len(ids), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*parent.columns, *numbers[:2], children, key_array(grown), numbers[2], added], _CHILD)
            # The groups' patterns: what each cell would add to their hulls.
            first = np.flatnonzero(batch["pos"].to_numpy() == batch["grp"].to_numpy())
            if len(first):
                bases = moved(forms.matrix[first], forms.shift[first], here.points[first])
                areas = np.array([added_areas(b, centers) for b in bases])
                rows, none = batch.select(["graph_id", "grp", "pos"]).take(pa.array(first)), key_array(forms).type
                empty = [pa.nulls(len(first), t) for t in (pa.int32(), pa.int32(), pa.list_(pa.int64()), none, pa.int32())]
                added = _lists(pa.array(areas.reshape(-1)), np.arange(1, len(first) + 1) * areas.shape[1])
                yield pa.RecordBatch.from_arrays([*rows.columns, *empty, added], _CHILD)

    return run


def seed(graphs: Graphs, settings: Settings) -> DataFrame:
    """Every edge between two places, as occurrences of order 2 with the key of a unit segment. One at a single place has no shape."""
    unit = round(1.0 / settings.quant)
    key = F.struct(
        F.array(F.struct(F.lit(0).alias("qx"), F.lit(0).alias("qy")), F.struct(F.lit(unit).alias("qx"), F.lit(0).alias("qy"))).alias("q"),
        F.array(F.struct(F.lit(0).alias("i"), F.lit(1).alias("j"))).alias("e"),
    ).cast(KEY)
    place = lambda c: graphs.vertices.select("graph_id", F.col("v").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    apart = graphs.edges.join(place("u"), ["graph_id", "u"]).join(place("w"), ["graph_id", "w"]).where(F.hypot(F.col("ux") - F.col("wx"), F.col("uy") - F.col("wy")) >= EPS)
    rows = apart.select("graph_id", F.lit(2).alias("ord"), key.alias("key"), F.array("u", "w").alias("occ"), F.lit(1).alias("n_edges"))
    return _ranked(rows, ["occ"])


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Give rows their pos and grp by a distributed sort; written, so that both stay as they are.

    The order is in pos too, so that pos and grp of different orders differ (up to 2**19 partitions of 2**33 rows).
    """
    pos = F.col("ord").cast("long") * (1 << 52) + F.monotonically_increasing_id()
    placed = stash(rows.orderBy("graph_id", *order).withColumn("pos", pos), "mining-order")
    groups = placed.groupBy("graph_id", "key").agg(F.min("pos").alias("grp"))
    return stash(placed.join(groups, ["graph_id", "key"]).select("graph_id", "ord", "key", "grp", "pos", "occ", "n_edges"), "mining-level")


def groups_of(occurrences: DataFrame) -> DataFrame:
    """graph_id, ord, key, grp, frequency, gain of every group."""
    found = occurrences.groupBy("graph_id", "ord", "key", "grp").agg(F.count("*").alias("frequency"))
    return found.withColumn("gain", F.col("frequency") * (F.col("ord") - 1))


def frequency_cut(groups: DataFrame, cut: float) -> DataFrame:
    """The most frequent groups of each graph: 1 - cut of them, at least one; ties by order, then by key. rank tells their order."""
    by = Window.partitionBy("graph_id").orderBy(F.desc("frequency"), F.desc("ord"), "key")
    ranked = groups.withColumn("rank", F.row_number().over(by)).withColumn("n", F.count("*").over(Window.partitionBy("graph_id")))
    return ranked.where((F.col("rank") <= F.greatest(F.lit(1.0), F.rint(F.col("n") * (1.0 - cut)))) | (F.col("n") == 1)).drop("n")


def expand(graphs: Graphs, level: DataFrame, settings: Settings) -> DataFrame:
    """The next level: children of all frequent cells, each vertex set once, groups of at least min_frequency."""
    context = in_context(level, graphs, "grp").select("graph_id", "grp", "pos", "context")
    grown = stash(context.mapInArrow(_grow(settings), _GROWN), "mining-grown")
    members = grown.where("child IS NOT NULL")
    cells = members.groupBy("graph_id", "grp", "ai", "di").agg(F.count("*").alias("n")).where(F.col("n") >= settings.min_frequency)
    added = grown.where("added IS NOT NULL").select("graph_id", "grp", "added")
    place = F.col("ai") * settings.grid.n_dist + F.col("di") + 1
    cells = cells.join(added, ["graph_id", "grp"]).select("graph_id", "grp", "ai", "di", (F.col("n") * F.element_at("added", place)).alias("score"))
    ordinal = F.struct("grp", (-F.col("score")).alias("worst"), "ai", "di", "pos")
    children = members.join(cells, ["graph_id", "grp", "ai", "di"]).groupBy("graph_id", "child", "key", "n_edges").agg(F.min(ordinal).alias("ordinal"))
    children = stash(children, "mining-children")
    kept = children.groupBy("graph_id", "key").agg(F.count("*").alias("frequency"), F.first(F.size("child")).alias("ord")).where(F.col("frequency") >= settings.min_frequency)
    order = ["ordinal"]
    if settings.frequency_cut > 0:
        kept = frequency_cut(kept, settings.frequency_cut)
        order = ["rank", "ordinal"]
    rows = children.join(kept.drop("frequency", "ord"), ["graph_id", "key"]).withColumn("ord", F.size("child")).withColumnRenamed("child", "occ")
    return _ranked(rows, order)


def detect(graphs: Graphs, settings: Settings | None = None, start: DataFrame | None = None) -> DataFrame:
    """All occurrences of all orders from 2 (or from `start`, rows like an OCCURRENCE) up to max_order, or until nothing repeats."""
    settings = settings or Settings()
    level = seed(graphs, settings) if start is None else start
    enough = level.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") >= settings.min_frequency).select("graph_id")
    level = stash(level.join(enough, "graph_id", "left_semi"), "mining-start")
    found, order = level, level.agg(F.min("ord")).first()[0]
    while order is not None and (settings.max_order is None or order < settings.max_order):
        level = expand(graphs, level, settings)
        order = level.agg(F.min("ord")).first()[0]
        if order is not None:
            found = found.unionByName(level)
    return found


def pattern_seed(graphs: Graphs, occurrences: DataFrame, settings: Settings) -> DataFrame:
    """Start rows from a user's occurrences (graph_id, pos, occ) of one shape, in the order of pos; none for those without an edge of positive length."""
    context = in_context(occurrences, graphs)

    def run(batches):
        for batch in _by_size(batches):
            batch = batch.filter(pa.array(Contexts(batch["context"]).shaped()))
            if not batch.num_rows:
                continue
            here = Contexts(batch["context"])
            forms, (count, n) = here.forms(settings.quant), here.ids.shape
            occ = _lists(pa.array(here.ids.reshape(-1)), np.arange(1, count + 1) * n)
            numbers = [pa.array(a, pa.int32()) for a in (np.full(count, n), forms.links.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([batch["graph_id"], numbers[0], key_array(forms), occ, numbers[1], batch["pos"]], ["graph_id", "ord", "key", "occ", "n_edges", "at"])

    keyed = context.mapInArrow(run, f"graph_id string, ord int, key {KEY}, occ array<long>, n_edges int, at long")
    return _ranked(keyed, ["at"]).drop("at")


def canonical_keys(graphs: Graphs, quant: float = 0.05) -> DataFrame:
    """graph_id, n_vertices, n_edges, key of whole graphs; alike graphs have equal rows but for the id."""
    whole = graphs.vertices.groupBy("graph_id").agg(F.array_sort(F.collect_list("v")).alias("occ")).withColumn("pos", F.lit(0).cast("long"))

    def run(frames):
        for df in frames:
            rows = []
            for r in df.itertuples(index=False):
                here = Local(r.context)
                rows.append((r.graph_id, len(here.ids), len(here.edges), key_struct(here.form(quant).key)))
            yield pd.DataFrame(rows, columns=["graph_id", "n_vertices", "n_edges", "key"])

    return in_context(whole, graphs).mapInPandas(run, f"graph_id string, n_vertices int, n_edges int, key {KEY}")


def alike(one: Graphs, other: Graphs, quant: float = 0.05) -> DataFrame:
    """Pairs (a, b) of graphs of equal size and shape up to rotation, uniform scale and shift."""
    key = lambda g, c: canonical_keys(g, quant).withColumnRenamed("graph_id", c)
    return key(one, "a").join(key(other, "b"), ["n_vertices", "n_edges", "key"]).select("a", "b")
