"""Removal of repeated word windows, with a count-min prefilter.

The documents are packed into units of about UNIT_BYTES, a row each, which later steps read again; a unit stands for a
partition. All that is sent goes from units to slices of a hash range, as many as the words need, and back.

Pass 1. A window's anchor is the 10-word run in it with the least hash (the leftmost one), so equal windows have equal
anchors, and one anchor serves about six windows. Every unit makes a count-min sketch of its anchors for each slice; it has
few cells that are not 0, so it is sent as the list of these. A slice merges all units' sketches into one, whose counts are
never below the number of places of an anchor, and tells each unit which of its cells count 2 or more. Neither keys nor
document ids are sent. Windows whose anchor counts 2 or more in all rows of the sketch may be repeated; no other one can be.

Pass 2. The windows left are grouped by 64 bits of one polynomial and 32 of another, independent one: among 10**12 different
windows two agree in both with a probability below 10**-5. A unit sends each of them once, with its first place; the slice
tells each unit whether that place is the first of all. All other places are removed.

A unit sends a value once, however often it has it, so a passage that a third of all rows share costs one entry for each
unit. A slice has the entries of at most about SLICE_WORDS words in memory, some 30 bytes for each repeated one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, workspace
from .shingles import Words, mix

WINDOW = 20
ANCHOR = 10
UNIT_BYTES = 8 << 20
#: Bytes whose words are hashed at once.
BATCH_BYTES = 1 << 20
#: Words for each slice at most, if spark.sql.shuffle.partitions are too few slices.
SLICE_WORDS = 8_000_000
#: Cells of the count-min sketch for each anchor that is expected, and its rows.
CELLS = 8
DEPTH = 2
#: Counts are told apart up to this.
ENOUGH = 2
_SLICE_SEED = 0x5851F42D4C957F2D
#: Null ids count as one document after all others.
_NO_ID = np.iinfo(np.int64).max


class CountMin:
    """Counts up to ENOUGH that are never too small, of keys that are hashes already.

    A partial sketch is sparse: for each row its cells that are not 0, ascending, and their counts. It is merged by addition.
    """

    def __init__(self, width: int, depth: int = DEPTH):
        self.cells = np.zeros((depth, width), np.uint8)

    @staticmethod
    def places(keys: np.ndarray, width: int, depth: int = DEPTH) -> list[np.ndarray]:
        return [(mix(keys, 0x9E3779B97F4A7C15 * (k + 1) % 2**64) & np.uint64(width - 1)).astype(np.uint32) for k in range(depth)]

    @staticmethod
    def partial(keys: np.ndarray, counts: np.ndarray, width: int, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for at in CountMin.places(keys, width, depth):
            cells, back = np.unique(at, return_inverse=True)
            out.append((cells, np.minimum(np.bincount(back, counts, len(cells)), ENOUGH).astype(np.uint8)))
        return out

    def merge(self, partial: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for row, (cells, counts) in zip(self.cells, partial, strict=True):
            row[cells] = np.minimum(row[cells] + counts, ENOUGH)

    def repeated(self, partial: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """For each row whether the partial sketch's cells count ENOUGH here."""
        return [row[cells] >= ENOUGH for row, (cells, _) in zip(self.cells, partial, strict=True)]


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length or several, compressed. Ascending ones are small as differences."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpacked(data: bytes, kinds: list) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(body, np.uint32, len(kinds), 4), 4 * (1 + len(kinds)), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _by_slice(keys: np.ndarray, slices: int) -> list[tuple[int, np.ndarray]]:
    """The slices that have any of the keys, with the places of these in their order."""
    of = (mix(keys, _SLICE_SEED) % np.uint64(slices)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cut = np.flatnonzero(np.diff(of[order])) + 1
    return [(int(of[at[0]]), at) for at in np.split(order, cut) if len(at)]


def _anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor at each place, the place of each window's anchor, and whether a window begins at each place."""
    grams, _ = words.runs(anchor, seed=1)
    n, span = len(grams), window - anchor + 1
    best, width = np.arange(n), 1
    while width < span:  # the least of `width` places on, then of twice as many
        step = min(width, span - width)
        other = best[np.minimum(np.arange(n) + step, n - 1)]
        best = np.where(grams[other] < grams[best], other, best)
        width += step
    count = np.diff(words.first)
    valid = np.arange(n) <= np.repeat(words.first[1:] - window, count)
    return grams, best, valid


# Units: (unit, n_words, ids, nulls, sizes, texts) with the ids, which of them are null, and the bytes of all texts.

_UNIT = "unit long, n_words long, ids binary, nulls binary, sizes binary, texts binary"


def _units(unit_bytes: int):
    def run(parts):
        made = TaskContext.get().partitionId() << 40
        ids, texts, held = [], [], 0

        def give():
            nonlocal made, ids, texts, held
            filled = np.array([_NO_ID if i is None else i for i in ids], np.int64)
            row = {
                "unit": made,
                "n_words": sum(len(t.split()) for t in texts),
                "ids": filled.tobytes(),
                "nulls": np.array([i is None for i in ids]).tobytes(),
                "sizes": np.array([len(t) for t in texts], np.int64).tobytes(),
                "texts": zstandard.ZstdCompressor(level=3).compress(b"".join(texts)),
            }
            made, ids, texts, held = made + 1, [], [], 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("unit", pa.int64()), ("n_words", pa.int64()), *[(c, pa.binary()) for c in ("ids", "nulls", "sizes", "texts")]]))

        for b in batches.pieces_of(parts):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text.encode())
                held += len(texts[-1])
                if held >= unit_bytes:
                    yield give()
        if ids:
            yield give()

    return run


class Unit:
    """A unit's texts, and its words in portions of about BATCH_BYTES."""

    def __init__(self, row: dict):
        self.number, self.ids = row["unit"], np.frombuffer(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        ends, body = np.cumsum(np.frombuffer(row["sizes"], np.int64)).tolist(), zstandard.ZstdDecompressor().decompress(row["texts"])
        self.texts = [body[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    def portions(self):
        """Lists of texts, with the index of the first."""
        first, held = 0, 0
        for i, t in enumerate(self.texts):
            if held and held + len(t) > BATCH_BYTES:
                yield first, self.texts[first:i]
                first, held = i, 0
            held += len(t) + 1
        yield first, self.texts[first:]

    def anchors(self, window: int, anchor: int):
        """For each portion the first text, the words' bounds, and _anchors."""
        for first, texts in self.portions():
            words = Words(texts)
            yield first, texts, words.first, *_anchors(words, window, anchor)


def _anchor_keys(portions: list) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a unit, ascending, and how many places they have, up to ENOUGH."""
    found = []
    for _, _, _, grams, best, valid in portions:
        found.append(grams[np.unique(best[valid])])
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    return keys, np.minimum(counts, ENOUGH)


#: A message of a unit to a slice, or (slice -1) what a unit keeps for itself.
_MESSAGE = "slice int, unit long, data binary"


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["slice", "unit", "data"])


def _sketch_rows(slices: int, width: int, window: int, anchor: int) -> Callable:
    def run(parts):
        for b in parts:
            for row in b.to_pylist():
                unit = Unit(row)
                keys, counts = _anchor_keys(list(unit.anchors(window, anchor)))
                out = []
                for k, at in _by_slice(keys, slices):
                    partial = CountMin.partial(keys[at], counts[at], width)
                    out.append((k, unit.number, _packed([x for cells, n in partial for x in (_steps(cells), n)])))
                yield _messages(out)

    return run


def _merged_sketch(width: int) -> Callable:
    """Merge the units' sketches of one slice, and tell each unit which of its cells are repeated."""

    def run(table: pa.Table) -> pa.Table:
        kinds = [np.uint32, np.uint8] * DEPTH

        def partials():
            for data in table.column("data"):
                flat = _unpacked(data.as_py(), kinds)
                yield [(np.cumsum(cells, dtype=np.uint32), n) for cells, n in zip(flat[::2], flat[1::2], strict=True)]

        sketch = CountMin(width)
        for partial in partials():
            sketch.merge(partial)
        answers = [_packed([np.packbits(x) for x in sketch.repeated(partial)]) for partial in partials()]
        return pa.table({"slice": table.column("slice"), "unit": table.column("unit"), "data": pa.array(answers, pa.binary())})

    return run


def _suspect(keys: np.ndarray, counts: np.ndarray, answers: list, slices: int, width: int) -> np.ndarray:
    """Those of a unit's anchors whose estimate is ENOUGH."""
    told = {x["slice"]: x["data"] for x in answers or []}
    found = []
    for k, at in _by_slice(keys, slices):
        may = np.ones(len(at), bool)
        bits = _unpacked(told[k], [np.uint8] * DEPTH)
        partial = CountMin.partial(keys[at], counts[at], width)
        for cells_of_keys, (cells, _), flags in zip(CountMin.places(keys[at], width), partial, bits, strict=True):
            may &= np.unpackbits(flags, count=len(cells)).astype(bool)[np.searchsorted(cells, cells_of_keys)]
        found.append(keys[at[may]])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _firsts(high: np.ndarray, low: np.ndarray, doc: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first (doc, start) of each distinct (high, low), and whether each of n rows is at that doc and start."""
    order = np.lexsort((start, doc, low, high))
    new = np.concatenate([[True], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)]) if n else np.zeros(0, bool)
    head = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))] if n else order
    same = np.zeros(n, bool)
    same[order] = (doc[order] == doc[head]) & (start[order] == start[head])
    return order[new], same


def _window_rows(slices: int, width: int, window: int, anchor: int) -> Callable:
    def run(parts):
        for b in parts:
            for row in b.to_pylist():
                unit = Unit(row)
                portions = list(unit.anchors(window, anchor))
                keys, counts = _anchor_keys(portions)
                suspects = _suspect(keys, counts, row["answers"], slices, width)
                found, begun = [], 0
                for first, texts, bounds, grams, best, valid in portions:
                    at = np.flatnonzero(valid & np.isin(grams, suspects)[best]) if len(suspects) else np.zeros(0, np.int64)
                    if len(at):
                        doc = np.searchsorted(bounds, at, side="right") - 1
                        high, low = (Words(texts, family).runs(window, seed=2)[0][at] for family in (0, 1))
                        found.append((high, low.astype(np.uint32), unit.ids[first + doc], (at - bounds[doc]).astype(np.uint32), begun + at))
                    begun += len(grams)
                if not found:
                    continue
                high, low, doc, start, place = (np.concatenate(x) for x in zip(*found, strict=True))
                one, is_first = _firsts(high, low, doc, start, len(high))
                one = np.sort(one)  # in the order of places, ids and starts are small as differences
                out, mine = [], []
                for k, at in _by_slice(high[one], slices):
                    at = one[at]
                    mine.append(place[at])
                    out.append((k, unit.number, _packed([high[at], low[at], _steps(doc[at]), _steps(start[at].astype(np.int64))])))
                # For itself it keeps its own later places, and the places it asks about in the order of the slices.
                asked = _packed([_steps(place[~is_first]), np.concatenate(mine), np.array([len(x) for x in mine]), np.array([k for k, _, _ in out])])
                yield _messages([*out, (-1, unit.number, asked)])

    return run


def _first_places(table: pa.Table) -> pa.Table:
    """Of one slice's windows, whether each unit's place is the first of all."""
    parts = [_unpacked(x.as_py(), [np.uint64, np.uint32, np.int64, np.int64]) for x in table.column("data")]
    high, low = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    doc, start = (np.concatenate([np.cumsum(p[k]) for p in parts]) for k in (2, 3))
    _, same = _firsts(high, low, doc, start, len(high))
    ends = np.cumsum([len(p[0]) for p in parts])
    answers = [_packed([np.packbits(same[z - len(p[0]) : z])]) for p, z in zip(parts, ends.tolist(), strict=True)]
    return pa.table({"slice": table.column("slice"), "unit": table.column("unit"), "data": pa.array(answers, pa.binary())})


def _kept_words(window: int, with_text: bool) -> Callable:
    names, kinds = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(parts):
        for b in parts:
            for row in b.to_pylist():
                unit, starts = Unit(row), []
                told = {x["slice"]: x["data"] for x in row["answers"] or []}
                if -1 in told:
                    late, asked, sizes, of = _unpacked(told[-1], [np.int64] * 4)
                    starts.append(np.cumsum(late))
                    for at, k in zip(np.split(asked, np.cumsum(sizes)[:-1]), of.tolist(), strict=True):
                        (bits,) = _unpacked(told[k], [np.uint8])
                        starts.append(at[~np.unpackbits(bits, count=len(at)).astype(bool)])
                edge = np.zeros(row["n_words"] + window + 1, np.int64)
                for at in starts:
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                gone, begun, out = np.cumsum(edge) > 0, 0, []
                for doc, null, text in zip(unit.ids.tolist(), unit.nulls.tolist(), unit.texts, strict=True):
                    words = text.split()
                    n = len(words)
                    if gone[begun : begun + n].any():
                        words = [words[i] for i in np.flatnonzero(~gone[begun : begun + n])]
                    begun += n
                    kept = b" ".join(words)
                    out.append((None if null else doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                for at in range(0, len(out), batches.OUT_ROWS):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out[at : at + batches.OUT_ROWS], strict=True), kinds, strict=True)], names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True, cells: int = CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row of docs (doc_id, text; other columns are ignored).

    A word goes if a window of `window` words of one document covers it whose words also begin at an earlier place, that is
    in a document with a smaller doc_id or earlier in the same one, in the input. Null text has no words. Rows with one
    doc_id are versions of one document: places with equal doc_id and start count as one place; rows with a null doc_id are
    versions of one document after all others. An empty table gives no rows.
    """
    units = workspace.stash(batches.documents(docs).mapInArrow(_units(UNIT_BYTES), _UNIT), "repeat-units")
    n_words = units.agg(F.sum("n_words")).first()[0] or 0
    slices = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_words // SLICE_WORDS))
    # About one place in (window - anchor + 2) / 2 is an anchor.
    width = 1 << max(4, int(cells * 2 * n_words / (window - anchor + 2) / slices).bit_length())

    def answered(sent: DataFrame, answer: Callable, own: DataFrame | None = None) -> DataFrame:
        """The units, with what all slices tell each of them."""
        told = sent.groupBy("slice").applyInArrow(answer, _MESSAGE)
        told = told if own is None else told.unionByName(own)
        return units.join(told.groupBy("unit").agg(F.collect_list(F.struct("slice", "data")).alias("answers")).hint("merge"), "unit", "left")

    sketches = units.mapInArrow(_sketch_rows(slices, width, window, anchor), _MESSAGE)
    suspects = answered(sketches, _merged_sketch(width))
    windows = workspace.stash(suspects.mapInArrow(_window_rows(slices, width, window, anchor), _MESSAGE), "repeat-windows")
    marked = answered(windows.where("slice >= 0"), _first_places, windows.where("slice < 0"))
    return marked.mapInArrow(_kept_words(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(s)
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM win
), gone AS (
  SELECT DISTINCT doc_id, s + j AS p FROM ranked, range(20) AS r(j) WHERE rn > 1
), word AS (
  SELECT doc_id, p, ws[p] AS x FROM w, unnest(range(1, len(ws) + 1)) AS t(p)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
