"""Language identification with bit-sliced Bloom filters of n-grams.

One table serves all languages: a cell is a bit mask with a bit for each language, and the conjunction of a gram's cells
names every language that contains the gram, however rarely. A second set of masks names those that have it often. The bits
of all grams of a text are counted for each language; what the filter answers by accident, which follows from each language's
share of set bits, is taken off, and the largest sum of both counts decides.

Training grams come from about TRAIN_DOCS labelled documents (all, if there are fewer), chosen by a hash of the id, with equal
parts for all languages, so that a rare one is not lost; whole texts are used, in training and in prediction.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .shingles import mix

GRAM = 4
CELL_BITS = 20
PROBES = 3
TRAIN_DOCS = 20_000
#: A language has a gram often if at this share of the rate of the language that has it most.
LEAST_SHARE = 0.34
UNDETERMINED = "und"

#: Numbers such as one half are no letters, but Python's word characters.
_LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")
#: Bytes of lower-cased UTF-8 that make up grams; every other one is a word border.
_KEPT = np.full(256, 32, np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of all texts, and the row of each. Runs of borders are one; texts begin and end with one."""
    data = [b" " + t.lower().encode() + b" " for t in texts]
    octets = _KEPT[np.frombuffer(b"".join(data), np.uint8)]
    row = np.repeat(np.arange(len(data), dtype=np.int32), [len(d) for d in data])
    single = np.ones(len(octets), bool)
    single[1:] = (octets[1:] != 32) | (octets[:-1] != 32) | (row[1:] != row[:-1])
    octets, row = octets[single], row[single]
    n = max(0, len(octets) - GRAM + 1)
    grams = np.zeros(n, np.uint32)
    for k in range(GRAM):
        grams |= octets[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    inside = row[:n] == row[GRAM - 1 :] if n else np.zeros(0, bool)
    return grams[inside], row[:n][inside]


def has_letter(text: str) -> bool:
    """Whether a character of text is a letter (Unicode category L)."""
    return any(unicodedata.category(m.group())[0] == "L" for m in _LETTER_OR_NUMBER.finditer(text))


class LanguageFilter:
    """Masks of languages in a table of 2**CELL_BITS cells, in as many 64-bit words as the languages need."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= k().itemsize * 8), np.uint64)
        self.width = kind().itemsize * 8
        self.tables = [np.zeros(1 << CELL_BITS, kind) for _ in range(-(-max(1, len(languages)) // self.width))]

    @staticmethod
    def cells(grams: np.ndarray) -> list[np.ndarray]:
        h = mix(grams.astype(np.uint64))
        return [((h >> np.uint64(CELL_BITS * k)) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64) for k in range(PROBES)]

    def add(self, language: int, grams: np.ndarray) -> None:
        table = self.tables[language // self.width]
        for cell in self.cells(grams):
            np.bitwise_or.at(table, cell, table.dtype.type(1 << language % self.width))

    def seal(self) -> LanguageFilter:
        """Work out how often each language is named by accident."""
        self.accident = np.array([((self.tables[i // self.width] >> (i % self.width)) & 1).mean() ** PROBES for i in range(len(self.languages))])
        return self

    def counts(self, grams: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Grams of each row that each language contains, without the accidental ones."""
        cells = self.cells(grams)
        total = np.bincount(row, minlength=rows)
        out = np.zeros((rows, len(self.languages)))
        for t, table in enumerate(self.tables):
            mask = table[cells[0]]
            for cell in cells[1:]:
                mask = mask & table[cell]
            for k in range(min(self.width, len(self.languages) - t * self.width)):
                out[:, t * self.width + k] = np.bincount(row[(mask >> k) & 1 == 1], minlength=rows)
        return np.maximum(0, (out - total[:, None] * self.accident) / np.maximum(1 - self.accident, 1e-9))


def _gram_counts(parts):
    for b in parts:
        langs = b.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            texts = [t for t, x in zip(b.column("text").to_pylist(), langs, strict=True) if x == lang]
            grams, n = np.unique(_grams(texts)[0], return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


@dataclass
class Model:
    """Which languages contain a gram, and which have it often."""

    contains: LanguageFilter
    often: LanguageFilter

    @property
    def languages(self) -> list[str]:
        return self.contains.languages

    def counts(self, grams: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        return self.contains.counts(grams, row, rows) + self.often.counts(grams, row, rows)


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model from labelled documents (doc_id, text, lang); rows with a null lang or text teach nothing.

    The driver gets the counts of grams from about train_docs documents, picked by a hash of their ids, not more, and a row
    for each language.
    """
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    models = Model(LanguageFilter(languages), LanguageFilter(languages))
    if languages:
        limit = {x: int(min(1.0, train_docs / len(sizes) / n) * (1 << 30)) for x, n in sizes.items()}
        limits = F.create_map(*[F.lit(v) for pair in sorted(limit.items()) for v in pair])
        sample = known.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(1 << 30)) < limits[F.col("lang")])
        counted = sample.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
        rate = counted["n"] / counted.groupby("lang")["n"].transform("sum")
        most = rate.groupby(counted["gram"]).transform("max")
        for i, lang in enumerate(languages):
            own = counted["lang"] == lang
            models.contains.add(i, counted.loc[own, "gram"].to_numpy().astype(np.uint32))
            models.often.add(i, counted.loc[own & (rate >= LEAST_SHARE * most), "gram"].to_numpy().astype(np.uint32))
    models.contains.seal()
    models.often.seal()
    return models


def _predict(model: Model):
    names = np.array([*model.languages, UNDETERMINED], dtype=object)

    def run(parts):
        for b in batches.pieces_of(parts, 2 << 20):
            texts = [t or "" for t in b.column("text").to_pylist()]
            grams, row = _grams(texts)
            score = model.counts(grams, row, len(texts)) if model.languages else np.zeros((len(texts), 0))
            total, best = score.sum(axis=1), score.argmax(axis=1) if model.languages else np.full(len(texts), 0)
            top = score.max(axis=1) if model.languages else np.zeros(len(texts))
            lettered = np.array([has_letter(t) for t in texts], bool)
            lang = np.where(lettered, names[best], UNDETERMINED)
            value = np.where(lettered & (total > 0), top / np.maximum(total, 1e-9), 0.0)
            yield pa.record_batch([b.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(np.clip(value, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text; other columns are ignored).

    The score is the winner's share of all languages' corrected counts. A null text or one without a letter is `und` with
    score 0; a text with letters but no known gram gets the first language with score 0. Ties go to the first language.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = train(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
