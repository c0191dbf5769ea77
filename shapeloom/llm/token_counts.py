"""Token counts with a digest cache.

Each content and the tokenizer's version have a SHA-256 digest. Contents whose pair of digests is stored are not encoded
again; of the others each distinct content is encoded once, and its count is appended to the cache. The text itself
travels at most once, dealt by doc id, so that neither a hot content nor a hot source makes a large task.

Null text counts as empty; repeated rows and ids each get their row; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches, tokens, workspace

#: A content with more than one row in this many is hot.
HOT_SHARE = 1_000

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("tokenizer_sha256", T.StringType()),
        T.StructField("content_sha256", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _encode(path: str):
    def run(parts):
        count = tokens.byte_counts(path).count
        for b in parts:
            n = [count(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("content_sha256"), pa.array(n, pa.int64())], names=["content_sha256", "n_tokens"])

    return run


def read_cache(spark, cache_path: str) -> DataFrame:
    """The stored counts; an empty table if nothing has been stored at this path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs; new counts are appended at cache_path."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    texts = batches.documents(docs).withColumn("content_sha256", F.unhex(batches.sha256_hex(F.col("text"))))
    keys = workspace.stash(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_sha256"), "token-keys")

    contents = workspace.stash(keys.groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "token-contents")
    stored = read_cache(spark, cache_path).where(F.col("tokenizer_sha256") == version).select("content_sha256", "n_tokens").dropDuplicates(["content_sha256"])
    misses = contents.drop("n").join(stored, "content_sha256", "left_anti")
    # One document stands for each missing content. A repeated doc id may bring further rows, which dropDuplicates removes.
    same = texts["doc_id"].eqNullSafe(misses["doc_id"]) & (texts["content_sha256"] == misses["content_sha256"])
    chosen = texts.join(misses.hint("shuffle_hash"), same, "left_semi").select("content_sha256", "text")
    counted = chosen.mapInArrow(_encode(tokenizer_path), "content_sha256 binary, n_tokens long")
    new = counted.dropDuplicates(["content_sha256"]).select(F.lit(version).alias("tokenizer_sha256"), "content_sha256", "n_tokens")
    new.write.mode("append").parquet(cache_path)

    counts = read_cache(spark, cache_path).where(F.col("tokenizer_sha256") == version).select("content_sha256", "n_tokens").dropDuplicates(["content_sha256"])
    # At most HOT_SHARE contents can each have more than one row in HOT_SHARE, so their counts have a proven bound, and the
    # many rows of a hot content need not meet in one task.
    hot = contents.where(F.col("n") > keys.count() / HOT_SHARE).select("content_sha256")
    hot = F.broadcast(counts.join(hot, "content_sha256", "left_semi"))
    out = keys.join(hot, "content_sha256").unionByName(keys.join(hot, "content_sha256", "left_anti").join(counts, "content_sha256"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of all documents, with a cache that starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, tokens.default_path("byte_bpe_50k.json"), workspace.fresh_path(spark, "token-cache"))
