"""The corpus pipeline: documents pass language, toxicity, near-duplicate and benchmark filters, and are encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Verdicts are by row, whether its id is null or repeated.

Null and empty texts, and texts without letters, are in no language and go in the first stage; later stages would keep them, each by itself. Of a group of near-duplicates the row of the
least id stays, and of equal ids the one that comes first in the stage's table. An empty table passes all stages; without labels no text is toxic, and without a benchmark none is contaminated.
Texts of any length pass whole. Further columns, of any names, stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import catalogue, decontamination, lang_id, near_dedup, piece_codec, toxicity
from loomgraph.llm.common import fresh
from loomgraph.runtime import discard, written


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, which is written with them so that each reading sees the same; and that column's name."""
    (name,) = fresh(docs, "row")
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def _without(docs: DataFrame, number: str, dropped: DataFrame) -> DataFrame:
    """Rows whose number is not in ``dropped(id)``, without it. That table is written first, so its size decides how it is joined."""
    (name,) = fresh(docs, "dropped")
    dropped = written(dropped.select(F.col("id").alias(name)), "dropped")
    return docs.join(dropped, F.col(number) == F.col(name), "left_anti").drop(number)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the model accepts as one of the languages that it knows."""
    predict = lang_id.predictor(spark, catalogue.language_model(docs))
    (name,) = fresh(docs, "language")
    return docs.withColumn(name, predict("text")).where(F.col(f"{name}.accepted")).drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.scorer(spark, catalogue.toxicity_model(docs, labels))
    (name,) = fresh(docs, "toxicity")
    return docs.withColumn(name, score("text")).where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group one row, the one with the least id; null ids come last."""
    rows, number = _numbered(docs)
    found = written(near_dedup.near_duplicates(rows, id_col=number).select("id", "component_id"), "components")
    own = rows.select(F.col(number).alias("own"), F.col("doc_id").isNull().alias("last"), "doc_id")
    # rows that are alone need no choice
    groups = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    grouped = written(found.join(groups, "component_id").join(own, F.col("id") == F.col("own")), "grouped")
    first = grouped.groupBy("component_id").agg(F.min(F.struct("last", "doc_id", "id")).alias("first")).select(F.col("first.id").alias("stays"))
    return _without(rows, number, grouped.join(first, F.col("id") == F.col("stays"), "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth."""
    rows, number = _numbered(docs)
    found = decontamination.decontaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=number)
    return _without(rows, number, found.where("contaminated"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    out = piece_codec.piece_codes(docs, public_tokenizers.path(catalogue.TOKENIZER), full=False)
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("piece_codec", encode_pieces),
]

#: Language and toxicity are trained models, and the codec is a library's: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each leaves is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
