"""Near-duplicates of word shingles with SetSketch registers.

A register is floor(1 - log_b(h)) of the least of a document's exponential hashes, truncated to 0..q+1: mergeable by maximum,
and equal in two documents with about the probability of their Jaccard similarity. Documents with one band of equal registers
are candidates. The likelihood of the counts of larger, smaller and equal registers, with the known set sizes, estimates the
similarity; candidates that may reach the threshold are verified on the full sets.

Equal sets are one class, and a bucket of n classes is never expanded into pairs:

1. Every class is held against one other, the pivot that most of its buckets have. What is linked becomes one part.
2. In the buckets that still have several parts, every class outside the largest part finds its most similar class of another
   part by registers; that one pair is verified, and parts are joined again.
3. In the buckets that have several parts even then, the classes outside the largest part are held against the others inside
   blocks of bounded size. A block has the full sets, verifies what the registers allow for, and gives out links only, one
   for each two parts. Pairs that share several buckets are looked at in the first one of them.

Step 3 is quadratic in the number of classes of one bucket that are similar and yet not linked, but only in comparisons
within blocks: no table has a row for each pair. The buckets miss a pair of similarity 0.75 with a probability of 5e-6, and
the likelihood's floor lies over four standard errors below the threshold; these are the only ways to lose a link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, workspace
from .components import components
from .shingles import mix, shingle_sets

SHINGLE = 5
REGISTERS = 128
BAND = 4
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
THRESHOLD = (75, 100)
#: Candidates with an estimate this far below the threshold are dropped: over four standard errors of 128 registers.
SLACK = 0.16
FLOOR = THRESHOLD[0] / THRESHOLD[1] - SLACK
#: Classes of one side of a block in step 3, and their shingles: outside the largest part, and all.
BLOCK = (256, 1024)
BLOCK_SHINGLES = 1 << 20
#: Classes held against one copy of a pivot's set.
FAN_OUT = 256
#: Candidates that are verified at once; the most similar ones come first, as one link is enough.
VERIFY_AT_ONCE = 64

_RNG = np.random.Generator(np.random.PCG64(8))
_FACTORS = _RNG.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; all 0 for the empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 1024):
            np.minimum(least, (x[at : at + 1024, None] * _FACTORS ^ _SHIFTS).min(axis=0), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(one, other)


def _likelihood(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray):
    """The largest possible similarities of pairs (rows), and the log-likelihood of similarities, concave in them."""
    more, less = (one > other).sum(axis=1), (one < other).sum(axis=1)
    same = one.shape[1] - more - less
    u = n_one / np.maximum(n_one + n_other, 1)
    v = 1 - u
    tiny = 1e-12

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(a, tiny)) + less * np.log(np.maximum(b, tiny)) + same * np.log(np.maximum(1 - a - b, tiny))

    return np.minimum(u / np.maximum(v, tiny), v / np.maximum(u, tiny)), likelihood


def estimate(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarities of pairs (rows) from their registers and set sizes."""
    high, likelihood = _likelihood(one, other, n_one, n_other)
    low = np.zeros(len(high))
    for _ in range(40):  # the likelihood is concave: keep the better third
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def reaches(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    """Whether the estimate is at least floor, without working it out: a concave likelihood then still rises there."""
    high, likelihood = _likelihood(one, other, n_one, n_other)
    step = 1e-6
    return (high >= floor) & ((high - floor < 2 * step) | (likelihood(np.full(len(high), floor + step)) >= likelihood(np.full(len(high), floor - step))))


def _sketch(parts):
    names = ["doc_id", "row_key", "n_shingles", "set_digest", "registers"]
    for b in batches.pieces_of(parts, 512 << 10):
        sets = shingle_sets([t.encode() for t in b.column("text").to_pylist()], SHINGLE)
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
        regs = [registers(s).tobytes() for s in sets]
        yield pa.record_batch([b.column("doc_id"), b.column("row_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.string()), pa.array(regs, pa.binary())], names=names)


def _sets(parts):
    """The full set of each text, as sorted 64-bit hashes."""
    for b in batches.pieces_of(parts, 512 << 10):
        sets = shingle_sets([t.encode() for t in b.column("text").to_pylist()], SHINGLE)
        yield pa.record_batch([b.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])


_BAND_SEEDS = (np.arange(REGISTERS // BAND, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    packed = np.ascontiguousarray(regs.reshape(len(regs), -1, BAND)).view(np.uint64).reshape(len(regs), -1)
    return mix(packed ^ _BAND_SEEDS).view(np.int64)


def _registers_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(parts):
    for b in parts:
        keys = band_keys(_registers_of(b.column("registers")))
        yield pa.record_batch([pa.array(keys.reshape(-1)), pa.array(np.repeat(b.column("node").to_numpy(), keys.shape[1]))], names=["key", "node"])


def _linked(common, n_one, n_other):
    part, whole = THRESHOLD
    return whole * common >= part * (n_one + n_other - common)


def _facing(key: int, i: int, at: np.ndarray, regs: np.ndarray, keys: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of `at` in another part than i that may be linked with it and meet it first in this bucket, and their equal registers."""
    at = at[label[at] != label[i]]
    same = (regs[at] == regs[i]).sum(axis=1)
    near = same >= (FLOOR - SLACK / 2) * REGISTERS  # far below, no likelihood reaches the floor
    at, same = at[near], same[near]
    if len(at):
        first = keys[i][(keys[at] == keys[i]).argmax(axis=1)] == key
        at, same = at[first], same[first]
    if len(at):
        may = reaches(regs[at], np.broadcast_to(regs[i], (len(at), REGISTERS)), n[at].astype(float), np.full(len(at), float(n[i])))
        at, same = at[may], same[may]
    return at, same


def _best_partners(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """key, node, partner, same: for each class on side 0 its most similar one in another part, with the number of equal registers.

    Classes that face one of them, if only as one of several, have a row without a partner.
    """
    node, label, n, side = (table.column(c).to_numpy() for c in ("node", "label", "n_shingles", "side"))
    regs, bucket = _registers_of(table.column("registers")), key[0].as_py()
    keys, others, out, faced = band_keys(regs), np.flatnonzero(side == 1), [], np.zeros(len(node), bool)
    for i in np.flatnonzero(side == 0):
        at, same = _facing(bucket, i, others, regs, keys, label, n)
        if len(at):
            best = same.argmax()
            faced[at] = True
            out.append((int(node[i]), int(node[at[best]]), int(same[best])))
    out += [(int(x), None, None) for x in node[faced]]
    columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
    return pa.table([pa.array([bucket] * len(out), pa.int64()), *columns], names=["key", "node", "partner", "same"])


def _links_in_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links (a, b) of classes on side 0 with others, one for each two parts, verified on the full sets."""
    node, label, n, side, few = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n_shingles", "side", "few"))
    regs, bucket = _registers_of(table.column("registers")), key[0].as_py()
    hashes = table.column("hashes").to_pylist()
    keys, others, up, out = band_keys(regs), np.flatnonzero(side == 1), {}, []

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i in np.flatnonzero(side == 0):
        # Two classes that are both outside the largest part stand on both sides: the lesser one leads.
        at, same = _facing(bucket, i, others[~(few[others] & (node[others] < node[i]))], regs, keys, label, n)
        at = at[np.argsort(-same, kind="stable")]
        own = np.frombuffer(hashes[i], np.uint64)
        while len(at):
            mine = root(int(label[i]))
            at = at[[root(int(x)) != mine for x in label[at]]]
            now, at = at[:VERIFY_AT_ONCE], at[VERIFY_AT_ONCE:]
            if not len(now):
                break
            sets = np.frombuffer(b"".join(hashes[k] for k in now), np.uint64)
            found = own[np.minimum(np.searchsorted(own, sets), len(own) - 1)] == sets
            common = np.add.reduceat(found.astype(np.int64), np.concatenate([[0], np.cumsum(n[now])[:-1]]))
            for k in now[_linked(common, len(own), n[now])]:
                if (other := root(int(label[k]))) != mine:
                    up[other] = mine
                    out.append((int(node[i]), int(node[k])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _verify(parts):
    """The pairs whose registers, then whose full sets reach the threshold."""
    for b in batches.pieces_of(parts, 8 << 20):
        sizes = [b.column(c).to_numpy().astype(float) for c in ("a_n", "b_n")]
        may = reaches(_registers_of(b.column("a_registers")), _registers_of(b.column("b_registers")), *sizes)
        keep = np.zeros(b.num_rows, bool)
        one, other = b.column("a_hashes"), b.column("b_hashes")
        for i in np.flatnonzero(may):
            x, y = np.frombuffer(one[i].as_buffer(), np.uint64), np.frombuffer(other[i].as_buffer(), np.uint64)
            keep[i] = _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
        yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. Every b has one pair; the set of an a with many pairs is dealt in several copies."""
    pairs = workspace.stash(pairs, "near-pairs")
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN_OUT).alias("copies"))
    dealt = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).alias("salt"))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n_shingles").alias(f"{c}_n"), F.col("registers").alias(f"{c}_registers"), F.col("hashes").alias(f"{c}_hashes"))
    a_side = side("a").join(copies, "a").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    return dealt.join(side("b"), "b").join(a_side, ["a", "salt"]).drop("salt").mapInArrow(_verify, "a long, b long")


def _blocks(members: DataFrame, labels: DataFrame, sets: DataFrame, *carry: str) -> DataFrame:
    """The buckets in several parts, in blocks (key, r, c): side 0 are classes outside the largest part, side 1 all.

    labels (id, component) are the parts so far.
    """
    marked = members.join(labels.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("label"))
    marked = workspace.stash(marked, "near-marked")
    parts = marked.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    rank = F.struct("n", "label")
    shape = parts.groupBy("key").agg(F.max_by("label", rank).alias("largest"), *[F.sum(c).alias(c) for c in ("n", "weight")], *[F.max_by(c, rank).alias(f"most_{c}") for c in ("n", "weight")], F.count("*").alias("n_parts"))
    count = lambda n, weight, size: F.ceil(F.greatest(n / size, weight / BLOCK_SHINGLES, F.lit(1))).cast("long")
    n, weight = F.col("n"), F.col("weight")
    shape = shape.where("n_parts > 1").select("key", "largest", count(n - F.col("most_n"), weight - F.col("most_weight"), BLOCK[0]).alias("rows"), count(n, weight, BLOCK[1]).alias("columns"))
    open_ = marked.join(workspace.stash(shape, "near-open"), "key").withColumn("few", F.col("label") != F.col("largest"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    row, column = F.pmod(F.xxhash64("node"), F.col("rows")), F.pmod(F.xxhash64("node"), F.col("columns"))
    one = open_.where("few").select("key", "node", "label", "few", F.lit(0).alias("side"), row.alias("r"), spread(F.col("columns")).alias("c"))
    other = open_.select("key", "node", "label", "few", F.lit(1).alias("side"), spread(F.col("rows")).alias("r"), column.alias("c"))
    n_tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A block's work is not in its bytes, so blocks are dealt over a fixed number of tasks.
    return one.unionByName(other).join(sets.select("node", "n_shingles", "registers", *carry), "node").repartition(n_tasks, "key", "r", "c")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, component (null without words), component_id of every row."""
    source = batches.documents(docs).withColumn("row_key", batches.row_key(F.col("doc_id"), F.col("text")))
    sketches = source.mapInArrow(_sketch, "doc_id long, row_key string, n_shingles long, set_digest string, registers binary")
    sketches = workspace.stash(sketches, "near-sketches")
    full = sketches.where("n_shingles > 0")
    # A class is a distinct set. Its number is made once and then read from the files; ids of documents may repeat or be null.
    first = F.min(F.struct("doc_id", "row_key", "n_shingles", "registers")).alias("first")
    classes = full.groupBy("set_digest").agg(first, F.min("doc_id").alias("rep")).select("set_digest", "rep", "first.row_key", "first.n_shingles", "first.registers")
    classes = workspace.stash(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    bands = classes.select("node", "registers").mapInArrow(_bands, "key long, node long")
    buckets = workspace.stash(bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"), "near-buckets")
    members = bands.join(buckets, "key").join(classes.select("node", "n_shingles"), "node")
    members = workspace.stash(members.select("key", "node", "pivot", "n_shingles"), "near-members")
    needed = classes.join(members.select("node").distinct(), "node", "left_semi").select("row_key", "node", "n_shingles", "registers")
    texts = source.select("row_key", "text").join(needed.select("row_key", "node").hint("shuffle_hash"), "row_key").dropDuplicates(["row_key"])
    sets = needed.drop("row_key").join(texts.mapInArrow(_sets, "node long, hashes binary"), "node")
    sets = workspace.stash(sets, "near-sets")

    def grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """The parts after more links; stars stand for the links so far."""
        so_far = [] if labels is None else [labels.select(F.col("id").alias("a"), F.col("component").alias("b"))]
        for more in so_far:
            links = links.unionByName(more)
        return workspace.stash(components(links), "near-labels")

    stars = members.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("shared"))
    stars = stars.groupBy(F.col("node").alias("b")).agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("a")).select("a", "b")
    labels = grown(None, _confirmed(stars, sets))
    near = _blocks(members, labels, sets).groupBy("key", "r", "c").applyInArrow(_best_partners, "key long, node long, partner long, same long")
    near = workspace.stash(near, "near-partners")
    best = near.where("partner IS NOT NULL").groupBy(F.col("node").alias("b")).agg(F.max_by("partner", F.struct("same", "partner")).alias("a")).select("a", "b")
    labels = grown(labels, _confirmed(best, sets))
    # Only classes that face another part by registers can still have a link.
    members = near.select("key", "node").distinct().join(members.select("key", "node", "n_shingles"), ["key", "node"])
    rest = _blocks(members, labels, sets, "hashes").groupBy("key", "r", "c").applyInArrow(_links_in_block, "a long, b long")
    labels = grown(labels, workspace.stash(rest, "near-links"))

    part = classes.join(labels.withColumnRenamed("id", "node"), "node", "left").select("set_digest", "rep", F.coalesce("component", "node").alias("component"))
    part = workspace.stash(part, "near-parts")
    least = part.groupBy("component").agg(F.min("rep").alias("component_id"))
    part = workspace.stash(part.join(least, "component").select("set_digest", "component", "component_id"), "near-components")
    linked = full.select("doc_id", "row_key", "n_shingles", "set_digest").join(part, "set_digest").drop("set_digest")
    alone = sketches.where("n_shingles = 0").select("doc_id", "row_key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "row_key", "n_shingles", "component", "component_id").unionByName(alone)


def group_near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no shingles and are linked with nothing. Rows with equal sets are one class. Every row of a
    repeated doc_id is returned with the component of its own text; all rows with a component's smallest doc_id are kept.
    A null doc_id is never a component's smallest one unless all are null; such a component's id is null, and it is kept.
    An empty table gives no rows.
    """
    return _grouped(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row, all columns, of each group of near copies: that of the smallest doc_id, of several such the least text digest.

    Texts without words all stay. Rows with one id and one text count as one row, and any of them stays. Null ids come last.
    """
    found = _grouped(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    kept = found.where("component IS NOT NULL").groupBy("component").agg(first).select(F.col("first.row_key").alias("row_key"))
    kept = workspace.stash(kept.unionByName(found.where("component IS NULL").select("row_key").distinct()), "near-kept")
    return batches.only_rows(docs, kept)


def op8_minhash_near_dup(spark, sf_dir: str) -> DataFrame:
    return group_near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
