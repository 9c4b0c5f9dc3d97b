"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's subwords are its character n-grams, with marks at its ends, lower-cased and hashed to buckets. A text is the mean
embedding of all its subwords. Training is stochastic gradient descent in numpy over a bounded sample of labelled rows, drawn by
language; each is used whole, and as a few short spans, so that short texts are known too.

Rejection: one more class stands for text in none of the languages. Its examples are made from the sample: words of random letters, of letters and digits,
of one repeated letter, of syllables in an order that no text has. So buckets that no language uses speak for it. A part of the sample that training
does not see, and strings made from it, fit a softmax temperature and the highest probability of that class that is accepted.

As mean and softmax are linear up to the last step, the trained model is one table of logits by bucket; a word's summed row
is looked up once per worker.

Rows: a null text and one without letters get ``und``, score 0, and are not accepted. Texts of any length are used whole, here and in training. Equal texts get
equal answers, and rows that are repeated are drawn once. Of equal scores the language that sorts first wins. An empty table gives an empty result; a sample without
labels gives a model that answers ``und`` only. Other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import held, named
from loomgraph.runtime import written

UNKNOWN = "und"
#: Labelled rows that are learnt from at most; with more languages than that, one row of each.
SAMPLE_ROWS = 3_000
BITS, DIM, GRAMS = 16, 16, (1, 2, 3, 4)
BUCKETS = 1 << BITS
#: Passes over the examples, and descent steps at least, which a small sample needs more passes for.
EPOCHS, LEAST_STEPS, RATE = 4, 8_000, 0.5
#: Words that are looked up at once.
CHUNK = 30_000
#: Words of the spans that a drawn row also gives, and of the strings that are made from it.
SPANS, STRINGS = (3, 12), (2, 12)
#: Of calibration texts in a known language, the part that may be rejected.
LOST = 0.001


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of lower-cased words, and the place of the word that each is from; word by word, rising."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = np.repeat(np.arange(len(words), dtype="int32"), [len(w) + 2 for w in words])
    hashes, places = [], []
    for g in GRAMS:
        n = len(chars) - g + 1
        if n <= 0:
            continue
        h = np.full(n, g, dtype="uint32")
        for k in range(g):
            h = (h ^ chars[k : k + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        inside = word[:n] == word[g - 1 : g - 1 + n]
        hashes.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))[inside])
        places.append(word[:n][inside])
    order = np.argsort(np.concatenate(places), kind="stable")
    return np.concatenate(hashes)[order], np.concatenate(places)[order]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # buckets x langs and one: a bucket's share of the logits; the last is text in no language
    bias: np.ndarray
    temperature: float = 1.0
    #: The highest probability of no language that is accepted.
    threshold: float = 0.5

    def answers(self, texts: list[str | None], rows: "WordRows") -> list[tuple[str, float, bool]]:
        out = [(UNKNOWN, 0.0, False)] * len(texts)
        asked = [k for k, t in enumerate(texts) if self.langs and has_letter(t)]
        if not asked:
            return out
        z = rows.logits([texts[k] for k in asked]) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best, most, none = p[:, :-1].argmax(1).tolist(), p[:, :-1].max(1).tolist(), p[:, -1].tolist()
        for k, b, m, x in zip(asked, best, most, none, strict=True):
            out[k] = (self.langs[b], min(1.0, m), x <= self.threshold)
        return out


class WordRows:
    """Per word the sum of its buckets' table rows and their number; forgotten all at once when full."""

    def __init__(self, model: LanguageModel, limit: int = 200_000):
        self.model, self.at = model, {}
        self.sums = np.zeros((limit, model.table.shape[1] + 1), dtype="float32")

    def _learn(self, words: list[str]) -> None:
        ids, place = subwords(words)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        n = len(self.at)
        self.sums[n : n + len(words), :-1] = np.add.reduceat(self.model.table[ids], first)
        self.sums[n : n + len(words), -1] = np.bincount(place)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def total(self, words: list[str]) -> np.ndarray:
        """One row per word; at most as many words as there are rows."""
        rows = list(map(self.at.get, words))
        if None in rows:
            new = {w for w, r in zip(words, rows, strict=True) if r is None}
            if len(self.at) + len(new) > len(self.sums):
                self.at.clear()
                new = set(words)
            self._learn(sorted(new))
            rows = list(map(self.at.get, words))
        return self.sums[rows]

    def logits(self, texts: list[str]) -> np.ndarray:
        """Per text that has a word; long texts and many texts are taken in pieces."""
        out = np.zeros((len(texts), self.sums.shape[1]))
        words: list[str] = []
        owners: list[int] = []
        firsts: list[int] = []

        def flush() -> None:
            if words:
                np.add.at(out, owners, np.add.reduceat(self.total(words).astype("float64"), firsts))
            for x in (words, owners, firsts):
                x.clear()

        for k, t in enumerate(texts):
            own = t.lower().split()
            for i in range(0, len(own), CHUNK):
                if len(words) >= CHUNK:
                    flush()
                owners.append(k)
                firsts.append(len(words))
                words += own[i : i + CHUNK]
        flush()
        return out[:, :-1] / np.maximum(1, out[:, -1:]) + self.model.bias


def buckets_of(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct buckets of a whole text and how many of its n-grams each has; None without words."""
    words = text.lower().split()
    if not words:
        return None
    total = np.zeros(BUCKETS, dtype="int64") if len(words) > CHUNK else None
    for k in range(0, len(words), CHUNK):
        ids = subwords(words[k : k + CHUNK])[0]
        if total is None:
            return np.unique(ids, return_counts=True)
        total += np.bincount(ids, minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def in_no_language(words: list[str], random: np.random.Generator) -> Iterator[str]:
    """Strings that look like text and are none: made of the characters of some words, and of any letters and digits."""
    letters = sorted({c for w in words for c in w.lower() if c.isalpha()}) or ["x"]
    latin = list("abcdefghijklmnopqrstuvwxyz")

    def string(kind: int) -> str:
        n = int(random.integers(2, 11))
        if kind == 0:
            return "".join(random.choice(latin, n))
        if kind == 1:
            return "".join(random.choice(letters, n))
        if kind == 2:
            return "".join(random.choice([*latin, *"0123456789"], n))
        if kind == 3:
            return str(random.choice(latin)) * n
        row = "qwertyuiopasdfghjklzxcvbnm"
        at = int(random.integers(0, len(row) - 4))
        return row[at : at + n]

    for size in STRINGS:
        kind = int(random.integers(0, 6))
        yield " ".join(string(int(random.integers(0, 5)) if kind == 5 else kind) for _ in range(size))


def examples(text: str, seed: int) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """The whole text, spans of it and strings in no language, each as (known, buckets, counts); the same for equal arguments."""
    random = np.random.default_rng(seed % (1 << 64))
    words = text.split()
    own = [text]
    for size in SPANS:
        if len(words) > size:
            at = int(random.integers(0, len(words) - size))
            own.append(" ".join(words[at : at + size]))
    around = words[: 2 * max(STRINGS)] if len(words) <= 2 * max(STRINGS) else [words[k] for k in random.integers(0, len(words), 2 * max(STRINGS))]
    found = [(known, buckets_of(t)) for known, t in [*((True, t) for t in own), *((False, t) for t in in_no_language(around, random))]]
    return [(known, *x) for known, x in found if x is not None]


Example = tuple[str | None, np.ndarray, np.ndarray]  # language (None: none), buckets, shares


def train(data: list[Example], calibration: list[Example], seed: int = 0) -> LanguageModel:
    """Deterministic for given examples in a given order."""
    langs = sorted({l for l, _, _ in data if l is not None})
    if not langs:
        return LanguageModel([], np.zeros((1, 0)), np.zeros(0))
    at = {l: i for i, l in enumerate(langs)} | {None: len(langs)}
    random = np.random.default_rng(seed)
    embed = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    weight, bias = random.normal(0, 0.1, (DIM, len(at))), np.zeros(len(at))
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, len(data))))
    steps, done = epochs * len(data), 0
    for _ in range(epochs):
        for k in random.permutation(len(data)):
            label, ids, share = data[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ embed[ids]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[at[label]] -= 1
            back = weight @ p
            weight -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            embed[ids] -= rate * np.outer(share, back)
    model = LanguageModel(langs, (embed @ weight).astype("float32"), bias)
    _calibrate(model, [(at[l], ids, share) for l, ids, share in calibration if l in at])
    return model


def _calibrate(model: LanguageModel, data: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """The temperature of least log loss, then the acceptance bound.

    The bound lies half way, in log odds, between what all but a part LOST of the known texts stay below and what all but as large a part of the strings
    reach. If these overlap, no more than LOST of the known texts are rejected.
    """
    if not data:
        return
    z = np.array([share @ model.table[ids] for _, ids, share in data], dtype="float64") + model.bias
    y = np.array([k for k, _, _ in data])

    def scores(temperature: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / temperature)
        return p / p.sum(1, keepdims=True)

    loss = {t: -np.log(np.maximum(1e-12, scores(t)[np.arange(len(y)), y])).mean() for t in np.geomspace(0.1, 10, 41)}
    model.temperature = float(min(loss, key=loss.get))
    none = scores(model.temperature)[:, -1]
    odds = np.log(np.clip(none, 1e-12, 1 - 1e-12) / (1 - np.clip(none, 1e-12, 1 - 1e-12)))
    known, strings = np.sort(odds[y < len(model.langs)]), np.sort(odds[y == len(model.langs)])
    if len(known):
        most = known[len(known) - 1 - int(LOST * len(known))]
        least = strings[int(LOST * len(strings))] if len(strings) else most
        model.threshold = float(1 / (1 + np.exp(-max(most, (most + least) / 2))))


def quotas(counts: dict[str, int], sample: int) -> dict[str, int]:
    """Rows by language, ``sample`` together or one of each: as even as the counts allow."""
    out, left = {}, sample
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = min(n, max(1, left // (len(counts) - k)))
        left -= out[label]
    return out


def _made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [
            (h, label, known, np.asarray(ids, "<u2").tobytes(), np.asarray(n / n.sum(), "<f4").tobytes())
            for h, label, text in zip(f["h"].tolist(), f["label"], f["text"], strict=True)
            for known, ids, n in examples(text, h)
        ]
        yield pd.DataFrame(rows, columns=["h", "label", "known", "ids", "shares"])


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_ROWS) -> LanguageModel:
    """Trains on at most ``sample`` labelled rows, whole texts, as many of each language as there are.

    A row is drawn by a hash of its id and text, and equal rows count once. Tasks send the buckets of the drawn texts, at most BUCKETS numbers for each, so
    what reaches the driver has a bound that does not depend on the input or on the length of texts. Every fifth drawn row calibrates.
    """
    labelled = named(rows, text=text_col, label=label_col, id=id_col).where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = labelled.select(F.col("label").cast("string").alias("label"), F.xxhash64("id", "text").alias("h"), "text")
    counts = {r.label: r["count"] for r in hashed.groupBy("label").count().collect()}
    if not counts:
        return train([], [])
    quota = quotas(counts, sample)
    chosen: list[tuple[str, int]] = []
    missing, factor = dict(quota), 2.0
    while missing:  # again with more hashes only where repeated rows leave a language short
        bounds = [(l, min(2**63 - 1, int(min(1.0, factor * quota[l] / counts[l] + 0.001) * 2**64) - 2**63)) for l in missing]
        asked = hashed.sparkSession.createDataFrame(bounds, "asked string, bound long")
        drawn = hashed.join(F.broadcast(asked), F.col("label") == F.col("asked")).where("h <= bound").select("label", "h").distinct()
        found: dict[str, list[int]] = {}
        for r in drawn.collect():
            found.setdefault(r.label, []).append(r.h)
        for label in list(missing):
            got = sorted(found.get(label, []))
            if len(got) >= quota[label] or factor * quota[label] >= counts[label]:
                chosen += [(label, h) for h in got[: quota[label]]]
                del missing[label]
        factor *= 16
    picked = hashed.sparkSession.createDataFrame(chosen, "_label string, _h long")
    texts = hashed.join(F.broadcast(picked), (F.col("h") == F.col("_h")) & (F.col("label") == F.col("_label"))).groupBy("h", "label").agg(F.first("text").alias("text"))
    made = written(texts.mapInPandas(_made, "h long, label string, known boolean, ids binary, shares binary"), "examples")
    data: list[Example] = []
    calibration: list[Example] = []
    places: dict[tuple[int, str], int] = {}
    for r in sorted(made.collect(), key=lambda r: (r.h, r.label, not r.known, r.ids, r.shares)):
        place = places.setdefault((r.h, r.label), len(places))
        one = (r.label if r.known else None, np.frombuffer(r.ids, "<u2").astype("int64"), np.frombuffer(r.shares, "<f4"))
        (calibration if place % 5 == 0 and len(chosen) >= 5 else data).append(one)
    return train(data, calibration)


def predictor(spark, model: LanguageModel):
    """A column function: text to struct(lang, score, accepted). The model has a fixed size and is sent once per executor."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double, accepted: boolean>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        memo = _rows_of(own)
        for texts in parts:
            yield pd.DataFrame(own.answers(texts.tolist(), memo), columns=["lang", "score", "accepted"])

    return predict


def _rows_of(model: LanguageModel) -> WordRows:
    """The worker's memo for this model."""
    return held(("language", zlib.crc32(model.table.tobytes()), model.table.shape), lambda: WordRows(model))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang, score, accepted per row."""
    rows = named(docs, id=id_col, text=text_col)
    answer: Column = predictor(docs.sparkSession, model)("text")
    return rows.select("id", answer.alias("a")).select("id", "a.lang", "a.score", "a.accepted")
