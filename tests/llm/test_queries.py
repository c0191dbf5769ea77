"""Queries with SQL, held-out accuracy of the models, and the pipeline against its stages' own rules."""

import bisect
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_brute_force import packed, plain_near_copies
from tokenizers import Tokenizer

import corpus_pipeline
from shapeloom.llm import registry, tokens, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.sql(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[want.columns.tolist()]
    key = want.columns.tolist()
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True), check_dtype=False)


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES["op2_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.97


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic = rows["toxic"] == 1
    assert rows.loc[toxic, "predicted"].mean() > 0.5 and rows.loc[~toxic, "predicted"].mean() < 0.05


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.workspace.stash(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    texts = [r["text"] for r in docs.select("text").collect()]
    assert len(set(texts)) == len(texts) < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == len(texts)


def leaks(words, items):
    """Whether 13 words of an item, or all of a shorter one, lie in a text but for a fifth of them: every place is tried."""
    for own in items:
        need = min(13, len(own))
        same = words[:, None] == own[None, :]
        places = len(words) - need + 1, len(own) - need + 1
        if need and places[0] > 0:
            equal = sum(same[k : k + places[0], k : k + places[1]].astype(int) for k in range(need))
            if equal.max() >= (0.8 * need if len(own) >= 6 else need):
                return True
    return False


def test_pipeline_against_a_plain_version(spark, tmp_path):
    """run() keeps, cuts and packs what plain loops over the same documents do; only the learned model is shared."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    labels, benchmark = read("labels"), read("benchmark")
    chosen = read("documents").join(labels.select("doc_id").withColumnRenamed("doc_id", "known"), F.expr("doc_id = known"), "left")
    for t, df in (("documents", chosen.where("known IS NOT NULL OR doc_id < 150").drop("known")), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in source.select("doc_id", "text").collect()]
    model = toxicity.train_on(source, labels)
    x = np.array([model.features(t or "") for _, t in docs])
    left = [d for d, score in zip(docs, model.score(x), strict=True) if score < 0.5]
    counts = [len(docs), len(left)]
    last = {}
    for doc, text in left:
        last[text or ""] = max(doc, last.get(text or "", doc))
    left = [(doc, text) for doc, text in left if last[text or ""] == doc]
    counts.append(len(left))
    near = plain_near_copies(left)
    left = [d for d in left if near[d][0] == 0 or near[d][1] == d[0]]
    counts.append(len(left))
    split = lambda t: np.array((t or "").lower().split(), dtype=object)
    items = [split(r["text"]) for r in benchmark.collect()]
    left = [d for d in left if not leaks(split(d[1]), items)]
    counts.append(len(left))
    assert all(a > b for a, b in zip(counts, counts[1:])), counts  # every stage has something to do
    coder, want = Tokenizer.from_file(tokens.default_path("word_bpe_49k.json")), set()
    for doc, text in left:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at : at + 4096]
            want.add((doc, k, at, len(piece), zlib.crc32(packed(piece))))
    rows = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(rows) == len(want)
    rooms = []
    for length in sorted((w[3] for w in want), reverse=True):
        k = bisect.bisect_left(rooms, length)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else 4096) - length)
    assert rows["sequence_id"].nunique() == len(rooms)
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 4096
