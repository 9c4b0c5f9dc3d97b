"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels.

A sentence's score is the logistic of a bias plus the weights of its distinct features: its words, and the
prefixes of its words. A document's is one minus the product of its sentences' chances of being clean. Only
document labels train it; afterwards the sentence scores locate what is toxic.

Features are screened first: those that occur in clean documents nearly as often as in toxic ones are left out. The rest
get weights by accelerated gradient descent on the noisy-or likelihood, under a Gaussian belief around the cautious log of how much more toxic documents
have them: where other sentences explain a document already, the likelihood says nothing about its rarer words, and the belief stays. A sentence without a known
feature, or of a score below FLOOR, has no chance of being toxic, so a clean text of any length stays clean.

Rows: a null or empty text has no sentence and scores 0. Equal texts get equal scores. Texts are scored, and learnt from, whole. Ids may have any
type; rows of one id are one document, of which the least text is learnt from. Of ties between equally rated features all are kept. An empty table gives an
empty result; a sample without toxic rows gives scores of 0. Other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Memo, held, named
from loomgraph.runtime import written

#: Labelled rows that are learnt from at most.
SAMPLE_ROWS = 10_000
PREFIXES = (3, 4, 5, 6)
#: A feature must occur in 3 toxic training texts and this part of them, and so many times as often as in clean ones.
LEAST, RATIO = 0.002, 8.0
BIAS = -11.0
#: Gradient steps, the strength of the belief for each toxic document, its caution in standard errors, and the largest weight.
STEPS, BELIEF, CAUTION, MOST = 300, 0.35, 2.0, 25.0
#: Sentences that score less have no chance of being toxic.
FLOOR = 0.01
SENTENCE = re.compile(r"[.!?\n]+")


def features(word: str) -> list[str]:
    """The bare lower-cased word, marked as whole, and its prefixes."""
    w = word.strip("\"'()[]{}<>,;:.!?*#$%&|-_").lower()
    return [f"{w} "] + [w[:k] for k in PREFIXES if len(w) > k] if w else []


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = BIAS

    def hits(self) -> Memo:
        """Word to the features with a weight; a tuple, empty for most words."""
        return Memo(lambda w: tuple(f for f in features(w) if f in self.weights), 24 << 20)

    def sentences(self, text: str | None, hits: Memo) -> list[tuple[str, float]]:
        """The sentences that have a word, and their scores; 0 for those without a known feature."""
        out = []
        for s in SENTENCE.split(text or ""):
            if words := s.split():
                known = set().union(*hits.many(words))
                p = float(1 / (1 + np.exp(-self.bias - sum(sorted(self.weights[f] for f in known))))) if known else 0.0
                out.append((s.strip(), p if p >= FLOOR else 0.0))
        return out

    def score(self, text: str | None, hits: Memo) -> float:
        """Noisy-or over the sentences. Most texts have no word of a known feature, which is seen without cutting sentences."""
        if not text or not any(hits.many(text.replace(".", " ").replace("!", " ").replace("?", " ").split())):
            return 0.0
        clean = 1.0
        for _, p in self.sentences(text, hits):
            clean *= 1 - p
        return float(1 - clean)


def _in_sentences(text: str, of: Memo) -> Iterator[set[str]]:
    for s in SENTENCE.split(text or ""):
        if words := s.split():
            yield set().union(*of.many(words))


def _counted(toxic: int, among: frozenset[str] | None):
    """Features, or those among the given ones, and how many of the texts with this label have each; added up per batch."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Memo(lambda w: tuple(f for f in features(w) if among is None or f in among), 16 << 20)
        for f in frames:
            seen: Counter = Counter()
            for text in f["text"][f["toxic"] == toxic]:
                seen.update(set().union(*_in_sentences(text, of)))
            yield pd.DataFrame({"feature": list(seen), "n": list(seen.values())})

    return rows


def _bags(at: dict[str, int]):
    """Per text its label and the features of its sentences that have any, as numbers."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Memo(lambda w: tuple(at[f] for f in features(w) if f in at), 16 << 20)
        for f in frames:
            found = [[sorted(s) for s in _in_sentences(t, of) if s] for t in f["text"]]
            yield pd.DataFrame({"toxic": f["toxic"], "sentences": found})

    return rows


def believed(toxic: float, n1: int, clean: float, n0: int) -> float:
    """The log of a feature's rate in toxic documents over that in clean ones, less two standard errors; never below 0."""
    ratio = np.log((toxic + 0.5) / n1) - np.log((clean + 0.5) / max(1, n0))
    return max(0.0, float(ratio - CAUTION * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))))


def train(names: list[str], belief: np.ndarray, bags: list[list[list[int]]], y: np.ndarray) -> ToxicityModel:
    """``bags``: per document the features of its sentences, as places in ``names``; ``belief``: their weights before training."""
    if not names:
        return ToxicityModel()
    rows, cols, bag = [], [], []
    for d, sentences in enumerate(bags):
        for known in sentences:
            rows += [len(bag)] * len(known)
            cols += known
            bag.append(d)
    rows, cols, bag = (np.array(x, dtype="int64") for x in (rows, cols, bag))
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def gradient(w: np.ndarray) -> np.ndarray:
        z = BIAS + np.bincount(rows, w[cols], len(bag))
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        chance = -np.expm1(clean)
        # d loss / d z of a sentence: p in clean documents, -p * clean / chance in toxic ones
        pull = np.where(y > 0, -np.exp(clean) / np.maximum(chance, 1e-9), 1.0) * share
        return np.bincount(cols, (p * pull[bag])[rows], len(w))

    w, strength = np.minimum(belief, MOST), BELIEF / max(1.0, y.sum())
    ahead, t, step = w.copy(), 1.0, 40.0
    for _ in range(STEPS):
        new = np.clip(ahead - step * (gradient(ahead) + strength * (ahead - belief)), 0.0, MOST)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / after * (new - w)
        w, t = new, after
    return ToxicityModel({f: float(x) for f, x in zip(names, w, strict=True) if x > 0})


def _drawn(rated: DataFrame, sample: int) -> DataFrame:
    """id, toxic of ``sample`` rows at most: all if there are no more, else up to half of it toxic ones; those of the least hashes of their id."""
    n = {r.toxic: r["count"] for r in rated.groupBy("toxic").count().collect()}
    toxic = min(n.get(1, 0), max(sample // 2, sample - n.get(0, 0)))
    parts = []
    for kind, quota in ((1, toxic), (0, sample - toxic)):
        part = rated.where(F.col("toxic") == kind)
        if n.get(kind, 0) > quota:  # tasks sort only what is likely to be drawn
            bound = int(min(1.0, 1.2 * quota / n[kind] + 0.001) * 2**64) - 2**63
            part = part.where(F.col("h") <= min(2**63 - 1, bound)).orderBy("h").limit(quota)
        parts.append(part.select("id", "toxic"))
    return parts[0].union(parts[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Trains on at most ``sample`` rows of ``labels(id_col, toxic)``, whole texts.

    Tasks read the drawn texts, a table of ``sample`` rows at most; what reaches the driver is features that are much more common in toxic texts,
    and which of them each sentence has.
    """
    rated = named(labels, id=id_col, toxic="toxic").where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = written(_drawn(rated.withColumn("h", F.xxhash64("id")), sample), "rated")
    texts = named(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").where("text IS NOT NULL")
    drawn = written(texts.groupBy("id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).select("toxic", "text"), "drawn")
    n = {r.toxic: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)

    def counts(toxic: int, among: frozenset[str] | None, least: float) -> dict[str, int]:
        found = drawn.mapInPandas(_counted(toxic, among), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        return {r.feature: r.n for r in found.where(F.col("n") >= least).collect()}

    often = counts(1, None, max(3, LEAST * n1)) if n1 else {}
    clean = counts(0, frozenset(often), 1) if often else {}
    names = sorted(f for f, k in often.items() if (k / n1) / ((clean.get(f, 0) + 0.5) / max(1, n0)) >= RATIO)
    if not names:
        return ToxicityModel()
    found = drawn.mapInPandas(_bags({f: i for i, f in enumerate(names)}), "toxic int, sentences array<array<int>>").collect()
    found = sorted((r.toxic, [list(s) for s in r.sentences]) for r in found)
    belief = np.array([believed(often[f], n1, clean.get(f, 0), n0) for f in names])
    return train(names, belief, [s for _, s in found], np.array([y for y, _ in found], dtype="float64"))


def _hits_of(model: ToxicityModel) -> Memo:
    return held(("toxicity", hash(tuple(sorted(model.weights.items())))), model.hits)


def scorer(spark, model: ToxicityModel):
    """A column function: text to score. The model's size depends on its bounded sample only."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        hits = _hits_of(own)
        for texts in parts:
            yield pd.Series([own.score(t, hits) for t in texts], dtype="float64")

    return score


def locator(spark, model: ToxicityModel, least: float = 0.5):
    """A column function: text to the sentences that score ``least`` or more, as structs (sentence, score)."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<sentence: string, score: double>>")
    def locate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        hits = _hits_of(own)
        for texts in parts:
            yield pd.Series([[{"sentence": s, "score": p} for s, p in own.sentences(t, hits) if p >= least] for t in texts])

    return locate


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score per row."""
    rows = named(docs, id=id_col, text=text_col)
    return rows.select("id", scorer(docs.sparkSession, model)("text").alias("score"))
