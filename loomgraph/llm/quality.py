"""Quality rules under weak supervision: rules vote or abstain, and a latent quality explains the votes.

Each rule looks at one measure of a text and votes good, bad, or not at all. Expectation-maximisation over all documents
estimates, per rule, how often good and bad documents draw each vote, and how common good ones are. A document's
posterior probability of being good, not the number of rules it fails, decides. The error rates of good documents are estimated
too, so a lone bad vote, which source code, tables or headings may draw, is a rule's error unless other rules join it. For that
the usual defects are each seen by more than one rule; what one rule alone sees is kept.

Only the number of documents by vote pattern reaches the driver: at most 3 to the number of rules, whatever the input.

Rows: a null or empty text has no words; it fails the base rules, and votes nowhere. Repeated rows count each. Texts of any length are measured
whole, and no rule looks at their length but the base rules' least number of words. A probability of just one half is kept, and a value that lies on a rule's bound abstains. An empty table
gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import named
from loomgraph.runtime import written

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
GOOD, ABSTAIN, BAD = 1, 0, -1
#: Fewer words, or a larger part of repeated ones, fail a text outright.
MIN_WORDS, MAX_REPEATED = 10, 20
#: ASCII characters that are neither letters, digits nor spaces.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Words of a block in which kinds of words are counted.
BLOCK = 50
#: Pseudo-documents behind the starting rates, the share of good ones among them, and EM's end.
WEIGHT, GOOD_SHARE, ROUNDS, CLOSE = 50.0, 0.85, 200, 1e-9


def numbered(words: list) -> tuple[np.ndarray, int]:
    """Each word as a number, equal ones alike, and how many there are."""
    seen: dict = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype="int64"), len(seen)


def repeated_words(ids: np.ndarray, kinds_n: int, size: int = 5) -> int:
    """Words that lie in a window of ``size`` words which occurs twice or more, its first occurrence included."""
    n = len(ids)
    if n <= size or kinds_n == n:
        return 0
    key = ids
    for k in range(1, size):  # ids of the windows of k + 1 words, exact as they are numbered anew each time
        key = key[:-1] * np.int64(kinds_n) + ids[k:]
        if k < size - 1:
            kinds, key = np.unique(key, return_inverse=True)
            if len(kinds) == len(key):
                return 0
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edges = np.zeros(n + 1, dtype="int64")
    starts = order[twice]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def block_kinds(ids: np.ndarray) -> tuple[int, int]:
    """The kinds of words in each block, added up, and the words of all blocks. A shorter last block counts only if it is the first."""
    n = len(ids) // BLOCK * BLOCK or len(ids)
    if not n:
        return 0, 0
    blocks = np.sort(ids[:n].reshape(-1, min(BLOCK, n)), axis=1)
    return int((blocks[:, 1:] != blocks[:, :-1]).sum()) + len(blocks), n


def measures(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES."""
    raw = (text or "").encode()
    words = raw.split()
    among = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else []
    ids, n_kinds = numbered(words)
    distinct = set(words)
    bare = {w for w in distinct if len(w) < 4 and not any(c.isalnum() for c in w.decode())}
    n_bare = sum(map(bare.__contains__, words)) if bare else 0
    dup_lines, n_symbols = len(lines) - len(set(lines)), among(SYMBOLS)
    held = {w for w in distinct if len(w.translate(None, SYMBOLS)) < len(w)} if n_symbols else set()
    n_held = sum(map(held.__contains__, words)) if held else 0
    base = len(words), len(text or "") - among(SPACES), n_symbols, dup_lines, repeated_words(ids, n_kinds)
    return *base, among(UPPER), among(LOWER), n_bare, *block_kinds(ids), n_held, among(MARKS)


#: Words, code points in words, symbols, lines equal to an earlier one, words in repeated windows, ASCII letters
#: of either case, short words without letter or digit, kinds of words in blocks and the words of these, words that hold a symbol, ASCII marks.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_bare", "n_block_kinds", "n_block_words", "n_symbol_words", "n_marks")


def _measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = pd.DataFrame([measures(t) for t in f["text"]], columns=list(MEASURES), dtype="int64")
        out.insert(0, "id", f["id"].to_numpy())
        yield out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measures per row."""
    rows = named(docs, id=id_col, text=text_col)
    return rows.mapInPandas(_measured, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))


@dataclass(frozen=True)
class Rule:
    """Good below ``good``, bad above ``bad``, and silent between or where ``applies`` is false."""

    name: str
    value: Column
    good: float
    bad: float
    applies: Column

    def vote(self) -> Column:
        return F.when(~self.applies, ABSTAIN).when(self.value > self.bad, BAD).when(self.value < self.good, GOOD).otherwise(ABSTAIN)


def rules() -> list[Rule]:
    n, some = F.col("n_words"), F.col("n_words") >= MIN_WORDS
    per_word = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    return [
        Rule("symbols", per_word("n_symbols"), 0.1, 0.5, some),
        Rule("repetition", per_word("n_repeat_words"), 0.1, 0.2, some),
        Rule("capitals", F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)), 0.3, 0.5, some),
        Rule("bare_words", per_word("n_bare"), 0.05, 0.15, some),
        Rule("few_kinds", 1 - F.col("n_block_kinds") / F.greatest(F.col("n_block_words"), F.lit(1)), 0.5, 0.7, some),
        Rule("long_words", F.col("word_chars") / F.greatest(n, F.lit(1)), 10.0, 15.0, some),
        Rule("symbol_words", per_word("n_symbol_words"), 0.1, 0.3, some),
        Rule("marks", F.col("n_marks") / F.greatest(F.col("word_chars"), F.lit(1)), 0.1, 0.2, some),
    ]


@dataclass
class QualityModel:
    """``rates[class][rule]``: chance of a good and of a bad vote; the rest abstains. Class 1 is good."""

    prior: float
    rates: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Of good against bad, per row of votes. An abstaining rule says nothing."""
        logs = np.log(self.rates)
        ratio = logs[1] - logs[0]
        return np.log(self.prior / (1 - self.prior)) + (votes == GOOD) @ ratio[:, 0] + (votes == BAD) @ ratio[:, 1]


def expectation_maximisation(votes: np.ndarray, n: np.ndarray) -> QualityModel:
    """``votes``: patterns by rules; ``n``: how many documents have each.

    Starts from rules that are seldom wrong on good documents, and keeps those beliefs as pseudo-documents (a Dirichlet prior), so
    the classes don't swap. The documents outweigh it: all rates, those of good documents included, are estimated.
    """
    rules_n = votes.shape[1]
    belief = np.array([[[0.55, 0.45]] * rules_n, [[0.99, 0.01]] * rules_n])
    model = QualityModel(GOOD_SHARE, belief.copy())
    before = np.inf
    for _ in range(ROUNDS):
        z = model.log_odds(votes)
        good = 1 / (1 + np.exp(-z))
        weights = np.stack([n * (1 - good), n * good])
        ups, downs = weights @ (votes == GOOD), weights @ (votes == BAD)
        seen = (ups + downs + WEIGHT)[:, :, None]
        model.rates = (np.stack([ups, downs], axis=2) + WEIGHT * belief) / seen
        model.prior = float((weights[1].sum() + WEIGHT * GOOD_SHARE) / (n.sum() + WEIGHT))
        if abs(model.prior - before) < CLOSE:
            break
        before = model.prior
    return model


def fit(measured_rows: DataFrame, by: list[Rule]) -> QualityModel:
    """Counts the vote patterns of all documents that have enough words to vote."""
    names = [r.name for r in by]
    patterns = measured_rows.select(*[r.vote().alias(r.name) for r in by]).groupBy(*names).count().collect()
    votes = np.array([[r[x] for x in names] for r in patterns], dtype="int64").reshape(-1, len(names))
    return expectation_maximisation(votes, np.array([r["count"] for r in patterns], dtype="float64"))


def posterior(model: QualityModel, by: list[Rule]) -> Column:
    """The model's probability of good as an expression over the measures."""
    logs = np.log(model.rates)
    ratio = logs[1] - logs[0]
    z = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for k, r in enumerate(by):
        z = z + F.when(r.vote() == GOOD, float(ratio[k, 0])).when(r.vote() == BAD, float(ratio[k, 1])).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept per row.

    Texts are measured once; the measures go to a table in the shared folder, which both the fit and the verdicts read.
    """
    table = written(measured(docs, id_col, text_col), "quality")
    by = rules()
    model = fit(table, by)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = table.withColumn("base_failed", failed).withColumn("quality", posterior(model, by))
    kept = ~F.col("base_failed") & (F.col("quality") >= 0.5)
    return judged.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", kept.alias("kept"))
