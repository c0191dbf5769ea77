"""Exact duplicates by skew-safe combining.

1. Each input partition combines its own copies: one row for each distinct content.
2. These rows meet by digest. Contents of a hot digest (more than one row in HOT_SHARE of all) are dealt over salts, more of
   them for more rows, so that no task gets a whole hot group; the others have one salt, for which this stage is the last one.
3. The winners of a hot digest's salts are combined.

Every stage groups by the digest and then compares whole contents, so equal digests of different texts stay apart.
The texts are shuffled once, after stage 1; later stages carry ids, and texts of hot digests only.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches, workspace

#: A digest with more than one row in this many is hot, so there are never more hot digests than this.
HOT_SHARE = 10_000
HOT_LEAST = 200
#: Salts of a hot digest at least, and rows of one salt at most if the input is dealt evenly.
SALTS = 64
SALT_ROWS = 1_000_000
#: Ids in one row.
CHUNK_IDS = 65_536

#: ids has the ids that aren't null, nulls is the number of the others.
_ROW = "digest string, hot boolean, salt int, text string, ids array<long>, nulls long"
_MERGED = _ROW + ", win long, total long"


def _add(batch: pa.RecordBatch, groups: dict) -> None:
    """Add the rows of a batch to groups: (digest, hot, salt) -> text -> [arrays of ids, number of null ids]."""
    keys = zip(*[batch.column(c).to_pylist() for c in ("digest", "hot", "salt", "text", "nulls")], strict=True)
    ids = batch.column("ids")
    flat, ends = ids.flatten().to_numpy(), np.cumsum(ids.value_lengths().to_numpy())
    for (digest, hot, salt, text, nulls), end, start in zip(keys, ends, [0, *ends[:-1]], strict=True):
        entry = groups[digest, hot, salt].setdefault(text, [[], 0])
        if end > start:
            entry[0].append(flat[start:end].copy())
        entry[1] += nulls


def _rows(groups: dict):
    """A row for each content, or several ones if it has many ids; win and total are those of the whole content."""
    names = ["digest", "hot", "salt", "text", "ids", "nulls", "win", "total"]
    kinds = [pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
    rows: list = []
    for (digest, hot, salt), texts in groups.items():
        for text, (arrays, nulls) in texts.items():
            ids = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
            win, total = (int(ids.max()) if len(ids) else None), len(ids) + nulls
            for at in range(0, max(1, len(ids)), CHUNK_IDS):
                rows.append((digest, hot, salt, text, ids[at : at + CHUNK_IDS], 0 if at else nulls, win, total))
                if len(rows) == 512:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _combine(max_bytes: int):
    """Combine rows of equal content. Beyond max_bytes of text the groups so far are given out: a later stage combines them."""

    def run(parts):
        groups, held = defaultdict(dict), 0
        for b in batches.pieces_of(parts):
            _add(b, groups)
            held += b.nbytes
            if held > max_bytes:
                for out in _rows(groups):
                    yield out.select(out.schema.names[:-2])
                groups, held = defaultdict(dict), 0
        for out in _rows(groups):
            yield out.select(out.schema.names[:-2])

    return run


def _merge_sorted(parts):
    """Rows come sorted by digest and salt, so only the last group of a batch may go on in the next one."""
    groups: dict = defaultdict(dict)
    for b in batches.pieces_of(parts):
        _add(b, groups)
        last = (b.column("digest")[-1].as_py(), b.column("hot")[-1].as_py(), b.column("salt")[-1].as_py())
        open_group = {last: groups.pop(last)}
        if groups:
            yield from _rows(groups)
        groups = defaultdict(dict, open_group)
    yield from _rows(groups)


def find_copies(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (columns doc_id, text; others are ignored).

    Null text is empty. Of equal texts the row with the largest doc_id stays. A doc_id that repeats with the same text
    counts for group_size each time, and each such row is returned. A null doc_id is less than all others: it stays only in a
    group without any other, whose keep_id is null. An empty table gives no rows. digest may name another digest column (for
    tests).
    """
    texts = batches.documents(docs)
    sha = batches.sha256_hex(F.col("text"))
    texts = texts.withColumn("digest", sha if digest is None else digest)
    counts = workspace.stash(texts.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT_LEAST), "copies-counts")
    total = texts.select("doc_id").count()
    # At most HOT_SHARE digests can each have more than total / HOT_SHARE rows, so this side has a proven bound.
    salts = F.greatest(F.lit(SALTS), F.ceil(F.col("n") / SALT_ROWS)).cast("int")
    hot = counts.where(F.col("n") > total / HOT_SHARE).select("digest", salts.alias("salts"))
    dealt = texts.join(F.broadcast(hot), "digest", "left").select(
        "digest",
        F.col("salts").isNotNull().alias("hot"),
        F.coalesce(F.pmod(F.spark_partition_id(), F.col("salts")), F.lit(0)).cast("int").alias("salt"),
        "text",
        F.array_compact(F.array("doc_id")).alias("ids"),
        F.col("doc_id").isNull().cast("long").alias("nulls"),
    )
    local = dealt.mapInArrow(_combine(64 << 20), _ROW)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = local.repartition(parts, "digest", "salt").sortWithinPartitions("digest", "hot", "salt").mapInArrow(_merge_sorted, _MERGED)
    hot_text = F.when(F.col("hot"), F.col("text")).alias("text")
    salted = workspace.stash(salted.select("digest", "hot", hot_text, batches.sha256_hex(F.col("text")).alias("text_sha256"), "ids", "nulls", "win", "total"), "copies-salted")
    # Several rows of one content have its whole ids between them, so their own counts add up. A hot content has a row for each
    # salt and for each CHUNK_IDS ids.
    own = F.size("ids") + F.col("nulls")
    final = salted.where("hot").groupBy("digest", "text").agg(F.max("win").alias("keep_id"), F.sum(own).alias("group_size"))
    warm = salted.where("hot").drop("win", "total").join(final.hint("merge"), ["digest", "text"])
    cold = salted.where(~F.col("hot")).withColumnsRenamed({"win": "keep_id", "total": "group_size"})
    columns = ["ids", "nulls", "text_sha256", "keep_id", "group_size"]
    both = warm.select(columns).unionByName(cold.select(columns))
    ids = F.concat("ids", F.array_repeat(F.lit(None).cast("long"), F.col("nulls").cast("int")))
    out = both.select(F.explode(ids).alias("doc_id"), "keep_id", "group_size", "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """One row, all columns, of each group of equal texts: the row with the largest doc_id.

    Null text is empty, and a null id is less than all others. Of rows that repeat both id and text any one stays.
    """
    found = find_copies(docs, digest).where("kept")
    keys = found.select(F.concat_ws(":", F.coalesce(F.col("keep_id").cast("string"), F.lit("null")), "text_sha256")).distinct()
    return batches.only_rows(docs, keys)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
