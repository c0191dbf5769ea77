"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words; words under a 0 are ignored, so a substituted word there does not hide a hit.
Hashes of all masked places of the test items are joined with those of the documents; around every hit the item is laid
over the document, and the overlap counts if enough of the aligned words are equal in some stretch of STRETCH words.

Every stretch with enough equal words has a hit inside it, and so has every item of 6 to 12 words with as large a share of
equal words; shorter items count where they stand word for word. Of the hits of one mask that follow each other on a
diagonal only the first is looked at, with the stretches that have it inside: all words from there to a later hit are equal,
so if a stretch around the later one has enough equal words, one around the first has too. So repetitive texts and items
cost no more than others.

The join has two forms with the same rows. A benchmark of at most BROADCAST_BYTES is sent to the tasks as an index and joined
there, and the documents are not shuffled. A larger one stays distributed: a filter of bounded size, merged from its
partitions, tells which masked places of the documents may have a partner, and these are joined by their hashes in a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, workspace
from .shingles import Words, mix

STRETCH = 13
SHARE = 0.8
#: Items of fewer words must stand in a document word for word.
TOLERANT = 6
#: Fixed masks with the least and the most words of the items they serve: 1 is a word that must agree, 0 one that is ignored.
LONGEST = 1 << 62
MASKS = (
    ("1", 1, 1),
    ("11", 2, 2),
    ("111", 3, 3),
    ("1111", 4, 4),
    ("11111", 5, 5),
    ("111", 6, 12),
    ("11101011", 13, LONGEST),
    ("11011101", 13, LONGEST),
    ("1110010111", 13, LONGEST),
    ("1100110101", 13, LONGEST),
    ("111111", 13, LONGEST),
)
#: A benchmark of more bytes of text is joined in a shuffle.
BROADCAST_BYTES = 8 << 20
#: Bits of the filter for each masked place of the items, at most in all, and its probes.
FILTER_BITS = 32
MOST_BITS = 1 << 30
PROBES = 4
#: Hits that are expanded at once.
AT_ONCE = 1 << 20
#: Bytes of documents that a task looks at together: words and their hashes take over thirty times as much.
PIECE = 512 << 10

#: Letters of scripts that are written without spaces: each is a word of its own.
_UNSPACED = re.compile("([฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿])")


def _words(texts: list[str]) -> Words:
    return Words([(t if t.isascii() else _UNSPACED.sub(r" \1 ", t)).encode().lower() for t in texts])


def _masked(words: Words, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words under mask `number` at each place, and whether the mask fits into the text there."""
    mask = MASKS[number][0]
    n, span, total = len(words.hash), len(mask), np.zeros(len(words.hash), np.uint64)
    m = max(0, n - span + 1)
    with np.errstate(over="ignore"):
        for j, bit in enumerate(mask):
            if bit == "1":
                total[:m] += mix(words.hash[j : j + m], 0xA0761D6478BD642F * (j + 1) % 2**64)
    count = np.diff(words.first)
    return mix(total, number + 1), np.arange(n) <= np.repeat(words.first[1:] - span, count)


def _seeds(words: Words, number: int, served: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with a masked hash, the hashes, and that of the place before in the same text (0 at its beginning).

    With served only texts whose length the mask serves have any.
    """
    keys, fits = _masked(words, number)
    count = np.diff(words.first)
    if served:
        _, least, most = MASKS[number]
        fits &= np.repeat((count >= least) & (count <= most), count)
    before = np.zeros_like(keys)
    before[1:] = keys[:-1]
    before[words.first[:-1][count > 0]] = 0
    at = np.flatnonzero(fits)
    return at, keys[at], before[at]


def _pair(keys: np.ndarray, before: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + mix(before, 0x2545F4914F6CDD1D))


class Index:
    """The masked hashes of items, sorted; a table of bits answers most questions at once."""

    BITS = 22

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        self.words = _words([t for _, t in items])
        row = np.repeat(np.arange(len(items)), np.diff(self.words.first))
        self.by_mask = []
        for number in range(len(MASKS)):
            at, keys, before = _seeds(self.words, number, served=True)
            order = np.lexsort((before, keys))
            at, keys, pairs = at[order], keys[order], _pair(keys, before)[order]
            # Places of one hash that follow one hash lie together.
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(at) else np.zeros(0, np.int64)
            end = np.append(first[1:], len(at))
            by = np.argsort(pairs[first], kind="stable")
            bits = np.zeros(1 << self.BITS, bool)
            bits[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.by_mask.append((number, at, row[at], keys, bits, pairs[first][by], first[by], end[by]))

    def hits(self, words: Words):
        """(row, item, word of the text, word of the item, mask) of every hit that begins a run, in arrays of about AT_ONCE rows."""
        row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        for number, at, item, keys, bits, pairs, first, end in self.by_mask:
            if not len(keys):
                continue
            place, here, before = _seeds(words, number, served=False)
            likely = bits[(here >> np.uint64(64 - self.BITS)).astype(np.int64)]
            place, here, before = place[likely], here[likely], before[likely]
            low, high = np.searchsorted(keys, here), np.searchsorted(keys, here, side="right")
            met = low < high
            place, here, before, low, high = place[met], here[met], before[met], low[met], high[met]
            if not len(place):
                continue
            # Without the places that follow the same hash as this one: they go on with an earlier hit.
            pair = _pair(here, before)
            k = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            known = (pairs[k] == pair) & (before != 0)
            cut, resume = np.where(known, first[k], low), np.where(known, end[k], low)
            start, stop = np.concatenate([low, resume]), np.concatenate([cut, high])
            place, n = np.concatenate([place, place]), stop - start
            place, start, n = place[n > 0], start[n > 0], n[n > 0]
            steps = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), AT_ONCE), side="right") if len(n) else []
            for a, z in zip(steps, [*steps[1:], len(n)], strict=True):
                if a < z:
                    count = n[a:z]
                    j = np.repeat(start[a:z] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    p = np.repeat(place[a:z], count)
                    yield np.stack([row[p], item[j], p - words.first[row[p]], at[j] - self.words.first[item[j]], np.full(len(p), number)], axis=1)


def _best(doc: np.ndarray, item: np.ndarray, place: int, at: int, number: int) -> tuple[int, int, int]:
    """Item laid over doc with its word `at` on word `place`: most equal words in a stretch that has the hit inside, the
    stretch's first word in doc, and its length."""
    need, span = min(STRETCH, len(item)), len(MASKS[number][0])
    back = min(at, place, need - span)
    ahead = min(len(item) - at, len(doc) - place, need)
    if back + ahead < need:
        return 0, 0, need
    same = np.concatenate([[0], np.cumsum(item[at - back : at + ahead] == doc[place - back : place + ahead])])
    in_stretch = same[need:] - same[:-need]
    k = int(np.argmax(in_stretch))
    return int(in_stretch[k]), place - back + k, need


def _enough(n_equal: int, of: int) -> bool:
    return n_equal >= (SHARE * of if of >= TOLERANT else of) and n_equal > 0


def _matches(index: Index, texts: list[str]) -> dict:
    """(row, item) -> (n_equal / of, n_equal, -first word, of) of the best overlap."""
    words, best = _words(texts), {}
    for hits in index.hits(words):
        for r, i, place, at, number in hits.tolist():
            n, start, of = _best(words.hash[words.first[r] : words.first[r + 1]], index.words.hash[index.words.first[i] : index.words.first[i + 1]], place, at, number)
            if _enough(n, of):
                value = (n / of, n, -start, of)
                best[r, i] = max(best.get((r, i), value), value)
    return best


def _find(index: Index):
    def run(parts):
        for b in batches.pieces_of(parts, PIECE):
            refs, best = b.column("ref"), _matches(index, b.column("text").to_pylist())
            rows = [(index.ids[i], -s, n, of) for (r, i), (_, n, s, of) in sorted(best.items())]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            found = refs.take(pa.array([r for r, _ in sorted(best)], pa.int64()))
            yield pa.record_batch([found, *[pa.array(c, pa.int64()) for c in columns]], names=["ref", "item_id", "first_word", "n_equal", "n_aligned"])

    return run


def _keep(index: Index):
    def run(parts):
        for b in batches.pieces_of(parts, PIECE):
            keep = np.ones(b.num_rows, bool)
            keep[[r for r, _ in _matches(index, [t or "" for t in b.column("text").to_pylist()])]] = False
            yield b.filter(pa.array(keep))

    return run


# The join in a shuffle.


def _item_seeds(parts):
    for b in batches.pieces_of(parts, 1 << 20):
        words = _words(b.column("text").to_pylist())
        row = np.repeat(np.arange(b.num_rows), np.diff(words.first))
        for number in range(len(MASKS)):
            at, keys, before = _seeds(words, number, served=True)
            columns = [keys.view(np.int64), before.view(np.int64), at - words.first[row[at]], np.full(len(at), number, np.int32)]
            yield pa.record_batch([b.column("item_key").take(pa.array(row[at])), *map(pa.array, columns)], names=["item_key", "seed", "item_before", "at", "number"])


def _item_words(parts):
    for b in batches.pieces_of(parts, 1 << 20):
        words = _words(b.column("text").to_pylist())
        hashes = [words.hash[x:y].tobytes() for x, y in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.record_batch([b.column("item_key"), b.column("item_id"), pa.array(hashes, pa.binary())], names=["item_key", "item_id", "item_words"])


def _bits_of(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's cells of each key. Two numbers from its hash give all probes."""
    step = mix(keys, 0x9E3779B97F4A7C15) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((keys + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)]


def _filter_parts(bits: int, piece: int):
    """A partition's filter, in pieces of `piece` bytes that have any bit."""

    def run(parts):
        table = np.zeros(bits // 8, np.uint8)
        for b in parts:
            for cell in _bits_of(b.column("seed").to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(table, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
        for k in range(0, len(table), piece):
            if table[k : k + piece].any():
                yield pa.record_batch([pa.array([k // piece], pa.int32()), pa.array([table[k : k + piece].tobytes()], pa.binary())], names=["piece", "bits"])

    return run


def _merged(table: pa.Table) -> pa.Table:
    whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
    return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """The merged filter of all seeds, of at most MOST_BITS; a larger benchmark only lets more places through."""
    bits = min(MOST_BITS, 1 << max(16, (FILTER_BITS * seeds.count()).bit_length()))
    piece = min(bits // 8, 1 << 20)
    rows = seeds.select("seed").mapInArrow(_filter_parts(bits, piece), "piece int, bits binary").groupBy("piece").applyInArrow(_merged, "piece int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["bits"], np.uint8)
    return out


#: Rows of a run (its words, the reference to its text and its first word there), and of masked places in runs.
_RUN = "run long, ref {kind}, run_first long, run_words binary, seed long, before long, place long, number int"


def _runs(likely: np.ndarray):
    """The masked places that the filter lets through, and each run of such places once, with the words around it."""

    def run(parts):
        bits, made = 8 * len(likely), TaskContext.get().partitionId() << 40
        for b in batches.pieces_of(parts, 1 << 20):
            words, met = _words(b.column("text").to_pylist()), []
            for number in range(len(MASKS)):
                at, keys, before = _seeds(words, number, served=False)
                may = np.ones(len(at), bool)
                for cell in _bits_of(keys, bits):
                    may &= (likely[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                met.append((at[may], keys[may].view(np.int64), before[may].view(np.int64), np.full(may.sum(), number, np.int32)))
            at, keys, before, number = (np.concatenate(x) for x in zip(*met, strict=True))
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, keys, before, number = at[order], keys[order], before[order], number[order]
            row = np.repeat(np.arange(b.num_rows), np.diff(words.first))[at]
            new = np.concatenate([[True], (np.diff(at) > 2 * STRETCH) | (np.diff(row) != 0)])
            of, begin = np.cumsum(new) - 1, np.flatnonzero(new)
            end = np.append(begin[1:], len(at)) - 1
            low = np.maximum(words.first[row[begin]], at[begin] - STRETCH)
            high = np.minimum(words.first[row[begin] + 1], at[end] + 2 * STRETCH)
            n, k = len(begin), len(at)
            runs = [made + np.arange(n), None, low - words.first[row[begin]]]
            hashes = pa.array([words.hash[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
            nulls = lambda kind, m: pa.nulls(m, kind)
            ref = b.column("ref")
            names = ["run", "ref", "run_first", "run_words", "seed", "before", "place", "number"]
            yield pa.record_batch([pa.array(runs[0]), ref.take(pa.array(row[begin])), pa.array(runs[2]), hashes, *[nulls(pa.int64(), n)] * 3, nulls(pa.int32(), n)], names=names)
            place = at - low[of]
            yield pa.record_batch([pa.array(made + of), nulls(ref.type, k), nulls(pa.int64(), k), nulls(pa.binary(), k), pa.array(keys), pa.array(before), pa.array(place), pa.array(number)], names=names)
            made += n

    return run


def _verify(parts):
    names = ["ref", "item_id", "item_key", "first_word", "n_equal", "n_aligned"]
    for b in batches.pieces_of(parts):
        rows, keep = [], []
        columns = [b.column(c).to_pylist() for c in ("run_words", "item_words", "place", "at", "number", "run_first")]
        for k, (doc, item, place, at, number, first) in enumerate(zip(*columns, strict=True)):
            n, start, of = _best(np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64), place, at, number)
            if _enough(n, of):
                keep.append(k)
                rows.append((first + start, n, of))
        found = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.record_batch([*[b.column(c).take(pa.array(keep, pa.int64())) for c in names[:3]], *[pa.array(c, pa.int64()) for c in found]], names=names)


def _shuffled(source: DataFrame, items: DataFrame) -> DataFrame:
    kind = source.schema["ref"].dataType.simpleString()
    # Numbers are made once and then read from files, so that tasks which run again see the same ones.
    items = workspace.stash(items.withColumn("item_key", F.monotonically_increasing_id()), "leaks-items")
    seeds = workspace.stash(items.mapInArrow(_item_seeds, "item_key long, seed long, item_before long, at long, number int"), "leaks-seeds")
    sent = workspace.stash(source.mapInArrow(_runs(_filter_of(seeds)), _RUN.format(kind=kind)), "leaks-places")
    places = sent.where("seed IS NOT NULL").select("run", "seed", "before", "place", "number")
    hits = places.join(seeds, ["seed", "number"]).where("before <> item_before OR before = 0").select("run", "place", "number", "item_key", "at")
    runs = sent.where("seed IS NULL").select("run", "ref", "run_first", "run_words")
    words = items.mapInArrow(_item_words, "item_key long, item_id long, item_words binary")
    found = hits.join(runs, "run").join(words, "item_key").mapInArrow(_verify, f"ref {kind}, item_id long, item_key long, first_word long, n_equal long, n_aligned long")
    rank = F.struct(F.col("n_equal") / F.col("n_aligned"), "n_equal", -F.col("first_word"))
    best = found.groupBy("ref", "item_key").agg(F.max_by(F.struct("item_id", "first_word", "n_equal", "n_aligned"), rank).alias("x"))
    return best.select("ref", "x.*")


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def _small(items: DataFrame) -> Index | None:
    """An index of the items, or None if they are too many to be sent."""
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return Index([(r["item_id"], r["text"]) for r in items.toLocalIterator()]) if size <= BROADCAST_BYTES else None


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_equal, n_aligned: one row for each document and the item that it has a passage of.

    first_word is where the best stretch begins in the document, n_equal of its n_aligned words equal the item's (A-Z taken
    as a-z; letters of scripts without spaces are words). An item of fewer than STRETCH words must lie in the document as a
    whole, one of fewer than TOLERANT word for word. Items and documents without words or with a null text match nothing.
    Rows that repeat an id and a text may come as one or as several; a null doc_id or item_id stays null; extra columns are
    ignored; an empty table on either side gives no rows.
    """
    items = _items(benchmark)
    source, index = batches.documents(docs), _small(items)
    if index is not None:
        return source.withColumnRenamed("doc_id", "ref").mapInArrow(_find(index), "ref long, item_id long, first_word long, n_equal long, n_aligned long").withColumnRenamed("ref", "doc_id")
    keyed = source.select(batches.row_key(F.col("doc_id"), F.col("text")).alias("ref"), "text")
    number = F.split("ref", ":")[0]
    return _shuffled(keyed, items).select(F.when(number != "null", number).cast("long").alias("doc_id"), "item_id", "first_word", "n_equal", "n_aligned")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text has no passage of an item. Rows are judged one by one, whatever their ids."""
    items = _items(benchmark)
    index = _small(items)
    if index is not None:
        return docs.mapInArrow(_keep(index), docs.schema)
    name = "ref" if "ref" not in docs.columns else "ref_" + "_".join(docs.columns)
    keyed = docs.withColumn(name, batches.row_key(F.col("doc_id"), F.col("text")))
    source = keyed.select(F.col(name).alias("ref"), F.coalesce("text", F.lit("")).alias("text"))
    leaks = _shuffled(source, items).select(F.col("ref").alias(name)).distinct()
    return keyed.join(leaks, name, "left_anti").select(docs.columns)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
