"""Token counts with a digest cache.

Content is keyed by a digest of the tokenizer's version and the normalised text. Counts that a cache table
has are joined; of the rest each distinct text is encoded once and appended to the cache.

Rows: null counts as empty. Repeated rows and ids each come back with the count of their own text, which is encoded once. Texts of any length
are counted whole. An empty table gives an empty result. Only the id and text columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loomgraph.llm.common import Memo, held, named
from loomgraph.runtime import scratch, written

CACHE_SCHEMA = "digest binary, n_tokens long"
#: Bytes of the words' counts that a worker remembers.
MEMO = 64 << 20
#: Missing digests that are sent to all executors at most, 32 bytes each.
FEW = 200_000


class _Library:
    """Counts whole texts with the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


class _Pieces:
    """Counts with the sentencepiece library.

    If no piece has a space mark behind another character, no merge can cross the start of a run of
    spaces. Then a text's count is the sum over its pieces between such places, and each distinct one goes
    through the library once. Models for which that doesn't hold encode whole texts.
    """

    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.local = self._is_local()
        self.memo = Memo(lambda w: len(self.model.encode(w)) if w else 1, MEMO)

    def _is_local(self) -> bool:
        try:
            from sentencepiece import sentencepiece_model_pb2 as pb
        except ImportError:
            return False
        m = pb.ModelProto()
        m.ParseFromString(self.model.serialized_model_proto())
        plain, trained = m.normalizer_spec, m.trainer_spec
        if plain.precompiled_charsmap or plain.remove_extra_whitespaces or not plain.add_dummy_prefix or not plain.escape_whitespaces:
            return False
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            return False
        kinds = {x.type for x in m.pieces}
        ordinary = [x.piece for x in m.pieces if x.type == x.NORMAL]
        return kinds <= {1, 2, 3, 6} and self.SPACE in ordinary and not any(self.SPACE in x.lstrip(self.SPACE) for x in ordinary)

    def count(self, texts: list[str]) -> list[int]:
        if not self.local:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [self._sum(t) for t in texts]

    def _sum(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(self.SPACE, " ").split(" ")
        if "" not in parts:
            return sum(self.memo.many(parts))
        total, spaces = 0, 0  # the library puts one space before what it gets, so one of each run is left out
        for p in parts[:-1]:
            if p:
                total += self.memo[" " * spaces + p]
                spaces = 0
            else:
                spaces += 1
        return total + self.memo[" " * spaces + parts[-1]]


def _counter(path: str) -> _Library | _Pieces:
    return held(("counter", path), lambda: _Pieces(path) if path.endswith(".model") else _Library(path))


def tokenizer_version(path: str) -> str:
    """A digest of the file and the library that reads it: another vocabulary or release makes other keys."""
    import sentencepiece
    import tokenizers

    library = ("sentencepiece", sentencepiece.__version__) if path.endswith(".model") else ("tokenizers", tokenizers.__version__)
    with open(path, "rb") as f:
        content = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(json.dumps([*library, content]).encode()).hexdigest()


def _encoded(path: str):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path)
        for f in frames:
            yield pd.DataFrame({"digest": f["digest"], "n_tokens": pd.Series(counter.count(f["text"].tolist()), dtype="int64")})

    return rows


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", cache: str | None = None) -> DataFrame:
    """id, n_bytes, n_tokens per row, and the cache table brought up to date.

    ``tokenizer`` is a .model or .json file that every executor has at the same path. ``cache`` is a folder of a
    Parquet table (digest, n_tokens) in a store that all executors share; by default a new one in the shared
    folder. Normalising replaces null by the empty text: further folding would change counts.

    Equal texts are brought to one before they move, so a hot text costs one row per task, and a text moves once at most. Counts come back
    by a join on the digest, whose hot keys the engine may split.
    """
    spark = docs.sparkSession
    cache = cache or scratch(spark, "token-cache")
    version = F.lit(tokenizer_version(tokenizer))
    rows = named(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("id", F.unhex(F.sha2(F.concat(version, F.lit(":"), F.col("text")), 256)).alias("digest"), "text")
    keys = keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).select("digest")
    except AnalysisException:
        known = None
    if known is None:
        texts = _one_each(keyed)
    else:
        seen = Observation()
        missing = written(keys.select("digest").distinct().join(known, "digest", "left_anti").observe(seen, F.count("*").alias("n")), "missing")
        if int(seen.get["n"]) <= FEW:
            texts = _one_each(keyed.join(F.broadcast(missing), "digest", "left_semi"))
        else:
            texts = _one_each(keyed).join(missing, "digest", "left_semi")
    texts.mapInPandas(_encoded(tokenizer), CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    stored = written(stored, "counts")  # a plain table: only then may the engine split a hot digest's rows
    return keys.join(stored, "digest").select("id", "n_bytes", "n_tokens")


def _one_each(keyed: DataFrame) -> DataFrame:
    """digest, text: one row per digest."""
    return keyed.groupBy("digest").agg(F.first("text").alias("text"))
