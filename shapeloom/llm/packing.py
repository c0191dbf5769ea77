"""Best-fit-decreasing packing of token sequences.

Only the lengths decide a packing, and there are at most `capacity` different ones. So the driver packs the histogram of
lengths: equal bins are one entry with a count, the open entries hang on a segment tree over remaining capacities, and the
tightest entry with room is found in log2(capacity) steps. The plan is what best fit decreasing would do piece by piece,
and its size depends on the capacity, not on the number of documents. Then every piece finds its place from its length and
its rank among the pieces of that length; ranks are made of a partition's own counters and of the counts of the partitions
before it, so no task sees all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import batches, tokens, workspace

CAPACITY = 4096
END_ID = 1


class CapacityTree:
    """For each remaining capacity whether bins with it are open; a node knows whether any is below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def put(self, room: int, there: bool) -> None:
        i = room + self.leaves
        self.any[i] = there
        while i > 1:
            i >>= 1
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def tightest(self, need: int) -> int | None:
        """The smallest open capacity of at least need."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Pack lengths (length -> number of pieces). Returns the runs and the number of bins.

    A run (length, rank, per_bin, bin, offset) says: from this rank on, pieces of this length fill consecutive bins from
    `bin` on, per_bin of them in each, the first one of a bin at `offset`. Runs come sorted by length and rank.
    """
    tree, entries = CapacityTree(capacity), defaultdict(list)  # room -> [(first bin, number of bins)]
    runs, bins = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if not entries[room]:
                tree.put(room, True)
            entries[room].append((first, n))

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = bins, -(-left // per)
                bins += n
            else:
                per = room // length
                first, n = entries[room].pop()
                if not entries[room]:
                    tree.put(room, False)
            full = min(n, left // per)
            rest = min(left - full * per, per - 1) if full < n else 0
            runs.append((length, rank, per, first, capacity - room))
            add(room - per * length, first, full)
            used = full
            if rest:
                add(room - rest * length, first + full, 1)
                used += 1
            if used < n:
                add(room, first + used, n - used)
            rank += full * per + rest
            left -= full * per + rest
    runs.sort()
    return np.array(runs, dtype=np.int64).reshape(-1, 5), bins


def place(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces by their length and rank."""
    shift = np.int64(1 << 48)
    at = np.searchsorted(runs[:, 0] * shift + runs[:, 1], length * shift + rank, side="right") - 1
    _, start, per, first, offset = runs[at].T
    k = rank - start
    return first + k // per, offset + k % per * length


def _cut(path: str, capacity: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(parts):
        ids, seen = tokens.word_ids(path).ids, defaultdict(int)
        part = TaskContext.get().partitionId()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for b in batches.pieces_of(parts):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                coded = ids(text) + end
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    piece = coded[at : at + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(piece), part, seen[n]))
                    seen[n] += 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _place(runs: np.ndarray):
    def run(parts):
        for b in parts:
            bins, offsets = place(runs, b.column("length").to_numpy(), b.column("rank").to_numpy())
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*keep, pa.array(bins), pa.array(offsets)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all rows of docs (doc_id, text; other columns are ignored) into sequences of at most capacity tokens.

    A document is its ids and then end_id; a null text is empty, so it is one token. Only longer documents are cut, into
    pieces of capacity tokens and a shorter last one. Rows that repeat are packed each time. An empty table gives no rows.
    """
    pieces = batches.documents(docs).mapInArrow(
        _cut(tokenizer_path, capacity, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long",
    )
    pieces = workspace.stash(pieces, "pack-pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = workspace.stash(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-counts")
    # One row for each length: at most `capacity` rows come to the driver.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(totals, capacity)
    # A partition has at most `capacity` lengths, but there is no bound on the partitions, so the counts are not broadcast.
    ranked = pieces.join(counts.drop("n").hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.default_path("word_bpe_49k.json"))
