"""Toxicity scores from a learned lexicon, matched with misspellings and weighed by context.

Training finds, among labelled documents, the words and the word beginnings that stand in toxic documents only. The words
make a trie; a Levenshtein automaton for one edit is intersected with it, so a text's word meets every term within one edit
without trying each of them. A hit's context - the words around it - tells quotation and report from abuse: context
words have scores learned from the windows around hits. A logistic model of the hits of each kind and of the context
scores gives the document's score.

Training uses about TRAIN_DOCS labelled documents (all, if there are fewer), chosen by a hash of the id. Whole texts count.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches

TRAIN_DOCS = 20_000
#: A term stands in at least this many training documents and this share of them is toxic.
LEAST_DOCS = 6
LEAST_SHARE = 0.8
#: So many toxic documents that chance alone would give them to a word with at most this probability.
CHANCE = 1e-6
STEM_SIZES = (3, 4, 5, 6, 7, 8)
CONTEXT = 6
CACHE_ENTRIES = 400_000
#: Only terms of this length have misspellings: shorter ones are one edit from too many words.
LEAST_FUZZY = 4
#: Words one edit from a term of at most this length may be words of their own; those that training finds in clean documents are no hits.
SHORT = 4

_WORD = re.compile(r"[^\W\d_]+(?:['’*@$!][^\W\d_]+)*")
#: Words as they may be masked: with digits and with runs of marks. Those that are no hit as a whole are read as the words in them.
_TOKEN = re.compile(r"[^\W_]+(?:['’*@$!]+[^\W_]+)*")
_MASKED = re.compile(r"\d|['’*@$!]{2}")
_SYMBOL = re.compile(r"[*@$!]{2,}|.", re.DOTALL)
_QUOTES = '"“”„«»‘’'
_QUOTED = re.compile(f"[{_QUOTES}]")


class FuzzyLexicon:
    """The Levenshtein automaton of up to `edits` edits, intersected with a trie of the lexicon.

    A position is a trie node and the edits spent on the way to it; a state is the set of positions that a word's letters so
    far allow. States and their transitions are made when a word first needs them, so a word costs one look-up for each
    letter, and most words reach the dead state after a few letters. A run of marks is one edit and stands for at most as
    many letters as it has marks.
    """

    DEAD = 0

    def __init__(self, terms: list[str], edits: int = 1):
        self.edits = edits
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in terms:
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                node = self.next[node][c]
            self.term[node] = term
        self.states: dict[frozenset, int] = {frozenset(): self.DEAD}
        self.positions: list[frozenset] = [frozenset()]
        self.moves: list[dict[str, int]] = [{}]
        self.start = self._state({(0, 0)})

    def _state(self, positions: set) -> int:
        """The number of a state, with the positions that left-out letters of a term lead to."""
        todo = list(positions)
        while todo:
            node, e = todo.pop()
            if e < self.edits:
                for child in self.next[node].values():
                    if (child, e + 1) not in positions:
                        positions.add((child, e + 1))
                        todo.append((child, e + 1))
        key = frozenset(positions)
        if key not in self.states:
            self.states[key] = len(self.positions)
            self.positions.append(key)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        after = set()
        for node, e in self.positions[state]:
            if letter in self.next[node]:
                after.add((self.next[node][letter], e))
            if e < self.edits:
                level = [node]
                after.add((node, e + 1))
                for _ in letter:
                    level = [child for n in level for child in self.next[n].values()]
                    after.update((child, e + 1) for child in level)
        to = self.moves[state][letter] = self._state(after)
        return to

    def search(self, word: str) -> dict[str, int]:
        """Term -> number of edits, of all terms within reach of the word."""
        state, moves = self.start, self.moves
        for c in ["*" * len(c) if len(c) > 1 else c for c in _SYMBOL.findall(word)] if _MASKED.search(word) else word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == self.DEAD:
                return {}
        found: dict[str, int] = {}
        for node, e in self.positions[state]:
            if self.term[node] is not None:
                found[self.term[node]] = min(e, found.get(self.term[node], e))
        return found


class ToxicityModel:
    """Lexicon, stems, context scores and the weights of the features."""

    FEATURES = 7
    SPLIT = -1

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms, self.stems = set(terms), set(stems)
        self.fuzzy = FuzzyLexicon(sorted(t for t in terms if len(t) >= LEAST_FUZZY))
        self.own: set[str] = set()
        self.context: dict[str, float] = {}
        self.weights = np.zeros(self.FEATURES + 1)
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def kind(self, word: str) -> int:
        """0: no hit, 1: a term, 2: a term with one edit, 3: a word with a stem; SPLIT: a masked word of which only parts are hits."""
        got = self.cache.get(word)
        if got is None:
            if word in self.terms:
                got = 1
            elif _MASKED.search(word):
                got = self.SPLIT if any(self.kind(w) for w in _WORD.findall(word)) else 2 if self.misspelt(word) else 0
            elif any(word[:n] in self.stems for n in STEM_SIZES if len(word) >= n):
                got = 3
            else:
                got = 2 if self.misspelt(word) else 0
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[word] = got
        return got

    def misspelt(self, word: str) -> bool:
        found = self.fuzzy.search(word)
        return bool(found) and (word not in self.own or any(len(t) > SHORT for t in found))

    def hits(self, text: str):
        """Kind, context words and whether quotation marks surround it, of every hit."""
        lower = text.lower()
        tokens = _TOKEN.findall(lower)
        cache = self.cache
        kinds = [cache.get(w) for w in tokens]
        if None in kinds:
            new = {w: self.kind(w) for w in {w for w, k in zip(tokens, kinds, strict=True) if k is None}}
            kinds = [new[w] if k is None else k for w, k in zip(tokens, kinds, strict=True)]
        if not any(kinds):
            return []
        words, places, found = [], [], []
        for m, kind in zip(_TOKEN.finditer(lower), kinds, strict=True):
            if kind in (1, 2) or not _MASKED.search(m.group()):
                parts = [(m.group(), m.span(), kind)]
            else:
                parts = [(p.group(), p.span(), self.kind(p.group())) for p in _WORD.finditer(lower, *m.span())]
            for word, place, k in parts:
                words.append(word)
                places.append(place)
                found.append(k)
        out = []
        for i in (i for i, k in enumerate(found) if k):
            a, z = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
            left, right = lower[places[a][0] : places[i][0]], lower[places[i][1] : places[z - 1][1] + 2]
            out.append((found[i], words[a:i] + words[i + 1 : z], bool(_QUOTED.search(left) and _QUOTED.search(right))))
        return out

    def features(self, text: str) -> np.ndarray:
        """Of the hits that sound like abuse: terms, misspelled terms, stems; of the others one sum; the share of hits; the extremes of context."""
        x = np.zeros(self.FEATURES)
        hits = self.hits(text)
        if not hits:
            return x
        scores = []
        for kind, around, quoted in hits:
            s = sum(self.context.get(w, 0.0) for w in around) - quoted
            scores.append(s)
            if s < -1:
                x[3] += 1
            else:
                x[kind - 1] += 1
        x[:4] = np.log1p(x[:4])
        x[4] = math.log1p(1000 * len(hits) / (20 + len(text)))
        x[5], x[6] = max(-4.0, min(scores)), min(4.0, max(scores))
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _word_rows(parts):
    """Each training document's distinct words and word beginnings, combined within the batch."""
    for b in batches.pieces_of(parts):
        tally: dict[str, list[int]] = {}
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            keys = words | {f"{w[:n]}-" for w in words for n in STEM_SIZES if len(w) > n}
            for k in keys:
                t = tally.setdefault(k, [0, 0])
                t[0] += 1
                t[1] += toxic
        yield pa.record_batch([pa.array(list(tally)), pa.array([t[0] for t in tally.values()], pa.int64()), pa.array([t[1] for t in tally.values()], pa.int64())], names=["key", "n", "toxic"])


def _feature_rows(model: ToxicityModel):
    def run(parts):
        for b in batches.pieces_of(parts):
            x = [model.features(t or "").tolist() for t in b.column("text").to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), b.column("toxic").cast(pa.int32())], names=["x", "toxic"])

    return run


def _context_rows(model: ToxicityModel):
    def run(parts):
        for b in batches.pieces_of(parts):
            tally: dict[str, list[int]] = {}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for word in {w for _, around, _ in model.hits(text or "") for w in around}:
                    t = tally.setdefault(word, [0, 0])
                    t[0] += 1
                    t[1] += toxic
            yield pa.record_batch([pa.array(list(tally), pa.string()), pa.array([t[0] for t in tally.values()], pa.int64()), pa.array([t[1] for t in tally.values()], pa.int64())], names=["key", "n", "toxic"])

    return run


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps. The intercept is not shrunk."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), ridge * len(x) * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """A model from rows (doc_id, text, toxic); rows with a null label teach nothing. Without rows every score is 0.5."""
    known = labelled.where("toxic IS NOT NULL").select("doc_id", "text", "toxic")
    share = min(1.0, train_docs / max(1, known.select("doc_id").count()))
    known = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))).persist()
    try:
        tally = known.mapInArrow(_word_rows, "key string, n long, toxic long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        # Terms that pass stand in at least LEAST_DOCS of a bounded number of documents, nearly always toxic ones.
        base = known.agg(F.avg("toxic")).first()[0] or 0.0
        least = max(LEAST_DOCS, math.ceil(math.log(CHANCE) / math.log(min(max(base, 1e-3), 0.9))))
        good = tally.where((F.col("n") >= least) & (F.col("toxic") >= LEAST_SHARE * F.col("n"))).select("key", "n").toPandas()
        stems = {k[:-1]: n for k, n in zip(good["key"], good["n"], strict=True) if k.endswith("-")}
        stems = {s for s in stems if not any(s[:n] in stems for n in STEM_SIZES if n < len(s))}
        terms = [k for k in good["key"] if not k.endswith("-") and not any(k[:n] in stems for n in STEM_SIZES if len(k) > n)]
        # A beginning that only one term has is that term, not a stem of many words.
        spread = tally.where(~F.col("key").endswith("-") & F.col("key").substr(1, STEM_SIZES[0]).isin(sorted({s[: STEM_SIZES[0]] for s in stems}) or [""])).select("key", "n").toPandas()
        for s in sorted(stems):
            under = spread.loc[spread["key"].str.startswith(s)]
            if len(under) and under["n"].max() > 0.5 * under["n"].sum():
                stems.discard(s)
                terms += [k for k in under.loc[under["n"] >= least, "key"] if k in set(good["key"])]
        model = ToxicityModel(sorted(set(terms)), sorted(stems))
        short = tally.where((F.length("key") <= SHORT + 1) & (F.length("key") >= LEAST_FUZZY - 1) & ~F.col("key").endswith("-"))
        clean = short.where((F.col("n") >= LEAST_DOCS) & (F.col("toxic") < 0.5 * F.col("n"))).select("key").toPandas()
        model.own = {k for k in clean["key"] if model.fuzzy.search(k)}
        around = known.mapInArrow(_context_rows(model), "key string, n long, toxic long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        around = around.where(F.col("n") >= LEAST_DOCS).toPandas()
        rows = known.mapInArrow(_feature_rows(model), "x array<double>, toxic int")
        if len(around):
            prior = around["toxic"].sum() / around["n"].sum()
            odds = np.log((around["toxic"] + 1) / (around["n"] - around["toxic"] + 1)) - math.log((prior + 1e-3) / (1 - prior + 1e-3))
            model.context = {k: float(np.clip(o, -2, 2)) for k, o in zip(around["key"], odds, strict=True) if abs(o) > 1}
            rows = known.mapInArrow(_feature_rows(model), "x array<double>, toxic int")
        # One row for each combination of features: most documents have no hit and share one.
        table = rows.groupBy("x", "toxic").count().toPandas()
        if len(table):
            x = np.repeat(np.array(table["x"].tolist()), table["count"], axis=0)
            model.weights = _fit(x, np.repeat(table["toxic"].to_numpy(), table["count"]))
    finally:
        known.unpersist()
    return model


def _predict(model: ToxicityModel):
    def run(parts):
        for b in batches.pieces_of(parts):
            x = np.array([model.features(t or "") for t in b.column("text").to_pylist()]).reshape(-1, model.FEATURES)
            yield pa.record_batch([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of every row of docs (doc_id, text; other columns are ignored). Null and empty texts have no hit."""
    return batches.documents(docs).mapInArrow(_predict(model), "doc_id long, score double")


def _keep(model: ToxicityModel, limit: float):
    def run(parts):
        for b in batches.pieces_of(parts):
            x = np.array([model.features(t or "") for t in b.column("text").to_pylist()]).reshape(-1, model.FEATURES)
            yield b.filter(pa.array(model.score(x) < limit))

    return run


def keep_clean(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, with a score below limit. The texts are not shuffled."""
    return docs.mapInArrow(_keep(model, limit), docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train_on(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from the labelled documents that are not held out; of repeated labels of one document the toxic one counts."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    return train(batches.documents(docs).where(~held_out(F.col("doc_id"))).join(known, "doc_id"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
