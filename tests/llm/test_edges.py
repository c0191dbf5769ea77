"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import tracemalloc

import pyarrow as pa
import pytest

from shapeloom.llm import decontaminate, exact_dedup, languages, licenses, near_dup, packing, substring_dedup, token_counts, token_files, tokens, toxicity, workspace

WORDS, BYTES = tokens.default_path("word_bpe_49k.json"), tokens.default_path("byte_bpe_50k.json")


def files(docs):
    path = workspace.fresh_path(docs.sparkSession, "test-files")
    token_files.write_ids(docs, WORDS, path, block=1000, chunk_ids=3000, by="bit")
    return token_files.read_digests(docs.sparkSession, path)


def toxic(docs):
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    return toxicity.score(docs, toxicity.train_on(docs, labels))


def leaks(docs):
    items = docs.sparkSession.createDataFrame([(1, "The same text, twice."), (2, None), (3, "")], "item_id long, text string")
    return decontaminate.overlaps(docs, items)


ALL = {
    "packing": lambda d: packing.pack(d, WORDS),
    "languages": lambda d: languages.predict(d, languages.train(d)),
    "substring": substring_dedup.remove_repeats,
    "leaks": leaks,
    "counts": lambda d: token_counts.count_tokens(d, BYTES, workspace.fresh_path(d.sparkSession, "test-cache")),
    "toxic": toxic,
    "files": files,
    "near": near_dup.group_near_copies,
    "exact": exact_dedup.find_copies,
    "licenses": licenses.scan,
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(name, nothing):
    assert ALL[name](nothing).collect() == []


@pytest.mark.parametrize("name", [n for n in ALL if n not in ("packing", "leaks")])
def test_a_row_for_each_row(name, messy):
    assert sorted(r["doc_id"] for r in ALL[name](messy).collect()) == sorted([*range(12), 3])


def test_messy_languages(messy):
    rows = {r["doc_id"]: r for r in ALL["languages"](messy).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in rows.values())


def test_messy_exact(messy):
    rows = {r["doc_id"]: r for r in ALL["exact"](messy).collect()}
    assert rows[0]["keep_id"] == rows[1]["keep_id"] == 1 and rows[0]["group_size"] == 2
    assert rows[3]["keep_id"] == 4 and rows[3]["group_size"] == 3 and rows[5]["kept"]


def test_exact_with_colliding_digests(messy):
    from pyspark.sql import functions as F

    plain = exact_dedup.find_copies(messy)
    weak = exact_dedup.find_copies(messy, digest=(F.length("text") % 2).cast("string"))
    assert sorted(plain.collect()) == sorted(weak.collect())


def test_exact_with_hot_digest(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END AS text").repartition(16)
    rows = exact_dedup.find_copies(docs).where("text_sha256 = sha2('hot', 256)").collect()
    assert len(rows) == 1000 and {(r["keep_id"], r["group_size"]) for r in rows} == {(2997, 1000)}


def test_exact_with_rows_that_repeat_in_a_hot_digest(spark, monkeypatch):
    """One row for each row, whatever the partitions, salts and chunks are, and whether the digests tell texts apart."""
    from collections import Counter

    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "CHUNK_IDS", 7)
    rows = [(None if i % 50 == 0 else i % 9 if i % 2 else i, ["hot", "warm", f"t{i % 400}", None][i % 4 if i % 3 else 0]) for i in range(1800)]
    docs = spark.createDataFrame([(*r, "a", i) for i, r in enumerate(rows)], "doc_id long, text string, row_key string, n int").repartition(12)
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    keep = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = Counter((doc, keep[text or ""], len(groups[text or ""]), doc == keep[text or ""]) for doc, text in rows)
    for digest in (None, F.lit("same"), F.length("text").cast("string")):
        got = exact_dedup.find_copies(docs, digest).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
        left = exact_dedup.keep_one(docs, digest).collect()
        assert Counter((r["doc_id"], r["text"] or "") for r in left) == Counter((k, t) for t, k in keep.items())


def test_messy_near(messy):
    rows = {r["doc_id"]: r for r in ALL["near"](messy).collect()}
    assert [rows[i]["component_id"] for i in (0, 1, 2)] == [0, 1, 2] and rows[0]["n_shingles"] == 0
    assert {rows[i]["component_id"] for i in (3, 4, 5)} == {3} and rows[7]["component_id"] == 6


def test_messy_leaks(messy):
    rows = ALL["leaks"](messy).collect()
    assert not {r["doc_id"] for r in rows} & {0, 1, 2, 8} and {r["item_id"] for r in rows} <= {1}


def test_null_ids_and_clashing_columns(spark):
    """Null ids are rows like others wherever ids only pass through; every operator takes them."""
    rows = [(None, "idiot words and some more words", 0), (None, None, 1), (5, "idiot words and some more words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, salt int").selectExpr("*", "'en' AS lang", "salt AS n", "'x' AS digest", "1L AS node")
    for name, f in ALL.items():
        ids = [r["doc_id"] for r in f(docs).collect()]
        assert name == "leaks" or sorted(ids, key=str) in ([5, None, None], [5, None], [None, None, 5]), (name, ids)


def test_digest_cache_is_used_again(spark, messy):
    cache = workspace.fresh_path(spark, "test-cache")
    first = token_counts.count_tokens(messy, BYTES, cache).collect()
    stored = token_counts.read_cache(spark, cache).count()
    again = token_counts.count_tokens(messy, BYTES, cache).collect()
    assert sorted(first) == sorted(again) and token_counts.read_cache(spark, cache).count() == stored == 10


def test_toxic_terms_behind_digits_marks_and_short_misspellings(spark):
    terms, plain = ["idiot", "stupid", "scum"], [f"w{chr(97 + i)}{chr(97 + i * 7 % 26)}word" for i in range(26)]
    text = lambda i, more: " ".join([plain[(i * 5 + j * 3) % 26] for j in range(9)] + more + [plain[(i * 11 + j) % 26] for j in range(9)])
    rows = [(i, text(i, [terms[i % 3]] if i % 4 == 0 else ["slum"] if i % 4 == 1 else ["1000", "a1b2"]), int(i % 4 == 0)) for i in range(600)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert model.terms == set(terms)
    bad = ["id1ot", "st**id", "skum", "scum", "stupid!!!you", "idiot2"]
    docs = spark.createDataFrame([(i, text(i, [w])) for i, w in enumerate([*bad, "slum", "2*3**4", "i**t"])], "doc_id long, text string")
    got = [r["score"] for r in sorted(toxicity.score(docs, model).collect())]
    assert min(got[: len(bad)]) > 0.5 > max(got[len(bad) :]), got


def test_decontamination_in_bounded_memory():
    """A batch of many megabytes takes a task little more than a small one."""
    index = decontaminate.Index([(1, " ".join(f"item{k}" for k in range(30)))])
    batch = pa.record_batch([pa.array([" ".join(f"w{(i * 7919 + k) % 50021}" for k in range(600)) for i in range(2000)])], names=["text"])
    tracemalloc.start()
    try:
        kept = sum(b.num_rows for b in decontaminate._keep(index)([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert kept == 2000 and batch.nbytes > 6 << 20 and peak < 64 << 20
