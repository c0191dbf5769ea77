"""Token-id files with bit-plane shuffling.

A file is a Parquet folder of chunks in ascending order of (shard, chunk); a shard holds a range of document ids. A chunk
holds whole documents: their ids and lengths (the index) and their token ids in blocks of a fixed number of ids. A block is
transposed into planes - the k-th byte, or the k-th bit, of all its ids - and each plane is compressed by itself with
zstandard, so the planes of high bits, which hardly ever change, cost next to nothing. Spark's writer commits whole tasks
only, so a lost executor leaves no half-written chunk.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import batches, tokens, workspace

BLOCK_IDS = 16_384
CHUNK_IDS = 262_144
END_ID = 2
LEVEL = 3
#: Bytes of input for one range of document ids, beyond the least number of ranges.
RANGE_BYTES = 256 << 20
UNKNOWN_BYTES = 1 << 60
CHUNK_SCHEMA = "shard int, chunk int, first_id long, doc_ids array<long>, n_ids array<long>, block_ids int, planes binary"


def shuffle_planes(ids: np.ndarray, by: str) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids: 4 of bytes or 32 of bits."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if by == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block again; the number of planes tells their kind."""
    if len(planes) == 4:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


def encode_chunk(ids: np.ndarray, block: int = BLOCK_IDS, by: str = "byte") -> bytes:
    """Blocks one after another: number of planes, each plane's compressed size, then the compressed planes."""
    press, out = zstandard.ZstdCompressor(level=LEVEL), []
    for at in range(0, len(ids), block):
        planes = [press.compress(p) for p in shuffle_planes(ids[at : at + block], by)]
        out.append(struct.pack(f"<I{len(planes)}I", len(planes), *map(len, planes)) + b"".join(planes))
    return b"".join(out)


def decode_chunk(data: bytes, n: int, block: int = BLOCK_IDS) -> np.ndarray:
    press, at, out = zstandard.ZstdDecompressor(), 0, []
    for done in range(0, n, block):
        k = struct.unpack_from("<I", data, at)[0]
        sizes = struct.unpack_from(f"<{k}I", data, at + 4)
        at += 4 + 4 * k
        planes = []
        for size in sizes:
            planes.append(press.decompress(data[at : at + size]))
            at += size
        out.append(join_planes(planes, min(block, n - done)))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def decode_slice(data: bytes, n: int, start: int, count: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ids from `start` on, `count` of them, of a chunk of n ids; blocks without any of them are skipped unread."""
    press, at, out = zstandard.ZstdDecompressor(), 0, []
    for first in range(0, min(n, start + count), block):
        k = struct.unpack_from("<I", data, at)[0]
        sizes = struct.unpack_from(f"<{k}I", data, at + 4)
        at += 4 + 4 * k
        size = min(block, n - first)
        if first + size > start:
            ends = np.cumsum(sizes)
            ids = join_planes([press.decompress(data[at + z - s : at + z]) for s, z in zip(sizes, ends.tolist(), strict=True)], size)
            out.append(ids[max(0, start - first) : start + count - first])
        at += sum(sizes)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def _chunks(path: str, end_id: int, block: int, chunk_ids: int, by: str):
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("block_ids", pa.int32()), ("planes", pa.binary())])

    def run(parts):
        ids, shard = tokens.word_ids(path).ids, TaskContext.get().partitionId()
        docs, sizes, held, total, first, chunk = [], [], [], 0, 0, 0

        def give():
            payload = encode_chunk(np.frombuffer(b"".join(held), "<u4"), block, by)
            return pa.RecordBatch.from_pylist([{"shard": shard, "chunk": chunk, "first_id": first, "doc_ids": docs, "n_ids": sizes, "block_ids": block, "planes": payload}], schema)

        for b in batches.pieces_of(parts):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                coded = ids(text) + end
                docs.append(doc)
                sizes.append(len(coded) // 4)
                held.append(coded)
                total += len(coded) // 4
                if total >= chunk_ids:
                    yield give()
                    first, chunk = first + total, chunk + 1
                    docs, sizes, held, total = [], [], [], 0
        if docs:
            yield give()

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, out_path: str, end_id: int = END_ID, block: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, by: str = "byte") -> None:
    """Write all rows of docs (doc_id, text; other columns are ignored) in ascending doc_id order.

    Null text is empty, so it gives only end_id. Rows with one doc_id stand next to each other, shorter texts first, so the
    order does not depend on how the input is dealt. An empty table gives an empty file.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Spark's own estimate of the input's size; an unknown size is no estimate.
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(parts, -(-size // RANGE_BYTES)) if size < UNKNOWN_BYTES else parts
    ordered = batches.documents(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.octet_length("text"), "text")
    ordered.mapInArrow(_chunks(tokenizer_path, end_id, block, chunk_ids, by), CHUNK_SCHEMA).write.mode("error").parquet(out_path)


def _decode(parts):
    for b in parts:
        for row in b.to_pylist():
            ids = decode_chunk(row["planes"], sum(row["n_ids"]), row["block_ids"])
            raw, at, crc = ids.astype("<u4").tobytes(), 0, []
            for n in row["n_ids"]:
                crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                at += n
            starts = row["first_id"] + np.concatenate([[0], np.cumsum(row["n_ids"])[:-1]])
            k = len(crc)
            yield pa.record_batch(
                [pa.array([row["shard"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["n_ids"], pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"],
            )


def read_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files at path, from the decoded ids."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    size = F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    # One row for each shard: as many as the writer had partitions.
    shards = chunks.select("shard", size.alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = chunks.mapInArrow(_decode, "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long")
    out = rows.join(F.broadcast(shards), "shard")
    return out.select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids (array) of the documents whose doc_id is in wanted, a row for each stored row.

    The index (ids and lengths, without the planes) tells which chunks and which blocks of them to open.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    sums = F.transform(F.sequence(F.lit(1), F.size("n_ids")), lambda k: F.aggregate(F.slice("n_ids", 1, k - 1), F.lit(0).cast("long"), lambda a, x: a + x))
    index = chunks.where(F.size("doc_ids") > 0).select("shard", "chunk", F.explode(F.arrays_zip("doc_ids", "n_ids", sums.alias("at"))).alias("x"))
    places = index.select("shard", "chunk", F.col("x.doc_ids").alias("doc_id"), F.col("x.n_ids").alias("n"), F.col("x.at").alias("at"))
    places = places.join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    places = places.groupBy("shard", "chunk").agg(F.collect_list(F.struct("doc_id", "at", "n")).alias("places"))
    total = F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")
    opened = chunks.select("shard", "chunk", "block_ids", "planes", total).join(places, ["shard", "chunk"])

    def run(parts):
        for b in parts:
            for row in b.to_pylist():
                ids = [decode_slice(row["planes"], row["total"], x["at"], x["n"], row["block_ids"]).tolist() for x in row["places"]]
                yield pa.record_batch([pa.array([x["doc_id"] for x in row["places"]], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return opened.mapInArrow(run, "doc_id long, ids array<long>")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    path = workspace.fresh_path(spark, "token-files")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.default_path("word_bpe_49k.json"), path)
    return read_digests(spark, path)
