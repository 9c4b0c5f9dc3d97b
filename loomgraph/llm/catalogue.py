"""The queries of the text operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, html_text, lang_id, licenses, near_dedup, piece_codec, quality, token_counts, toxicity, warc
from loomgraph.llm.common import crc_fold
from loomgraph.runtime import scratch

TOKENIZER = "piece_bpe_32k.model"
CONTEXT = 4096
LANG_FOLDS, LANG_HELD = 4, 2
TOXIC_FOLDS, TOXIC_HELD = 5, 0


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def token_count_query(spark: SparkSession, folder: str) -> DataFrame:
    out = token_counts.token_counts(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))


def near_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def language_model(docs: DataFrame) -> lang_id.LanguageModel:
    """Learnt from the rows that are not held out."""
    return lang_id.fit(docs.where(crc_fold(F.col("doc_id"), LANG_FOLDS) != LANG_HELD))


def language_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    out = lang_id.predict_languages(docs, language_model(docs))
    held = crc_fold(F.col("id"), LANG_FOLDS) == LANG_HELD
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), F.col("lang").alias("lang_pred"), "score", "accepted")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learnt from the rows that are not held out."""
    return toxicity.fit(docs, labels.where(crc_fold(F.col("doc_id"), TOXIC_FOLDS) != TOXIC_HELD))


def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    out = toxicity.score_toxicity(docs, toxicity_model(docs, _table(spark, folder, "labels")))
    held = crc_fold(F.col("id"), TOXIC_FOLDS) == TOXIC_HELD
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def warc_query(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "archive")
    warc.write_archive(_table(spark, folder, "pages"), path)
    return warc.read_archive(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def license_query(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def html_query(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(_table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_quality(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def decontamination_query(spark: SparkSession, folder: str) -> DataFrame:
    out = decontamination.decontaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


def piece_query(spark: SparkSession, folder: str) -> DataFrame:
    out = piece_codec.piece_codes(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), full=False)
    return out.withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_count_query,
        "op2_near_dedup": near_dedup_query,
        "op3_language_id": language_query,
        "op4_toxicity": toxicity_query,
        "op5_warc": warc_query,
        "op6_license_scan": license_query,
        "op7_html_text": html_query,
        "op8_quality_rules": quality_query,
        "op9_decontamination": decontamination_query,
        "op10_piece_codec": piece_query,
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _near_dedup_sql() -> str:
    size, percent = near_dedup.SHINGLE, near_dedup.PERCENT
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') l FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, l[k:k + {size - 1}] g FROM (SELECT doc_id, l, unnest(range(1, greatest(1, len(l) - {size - 1}) + 1)) k FROM w WHERE len(l) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM k UNION SELECT b, a FROM k),
t(id, x) USING KEY (id) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, min(t.x) FROM t JOIN e ON e.a = t.id JOIN recurring.t o ON o.id = e.b WHERE t.x < o.x GROUP BY 1)
SELECT t.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, t.x AS component_id, t.id = t.x AS kept FROM t LEFT JOIN n ON n.doc_id = t.id
"""


def _warc_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), d AS (SELECT page_id, octet_length(encode(h))::BIGINT b, sha256(h) s FROM p),
f AS (SELECT *, CASE WHEN b >= {warc.REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY s) ELSE page_id END first FROM d)
SELECT page_id, b AS payload_bytes, s AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN first = page_id THEN NULL ELSE first END::BIGINT AS refers_to FROM f
"""


def _canonical_sql(text: str) -> str:
    quoted = lambda x: x.replace("'", "''")
    plain = f"regexp_replace(lower({text}), '{quoted(licenses.COPYRIGHT)}', ' ', 'g')"
    plain = f"concat(' ', trim(regexp_replace({plain}, '{licenses.NOT_WORD}', '  ', 'g')), ' ')"
    for old, new in licenses.SPELLINGS:
        plain = f"replace({plain}, '{licenses.spaced(old)}', '{licenses.spaced(new)}')"
    return f"trim(replace({plain}, '  ', ' '))"


def _license_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in licenses.KNOWN)
    return f"""
WITH r(license, text) AS (VALUES {rows}),
k AS MATERIALIZED (SELECT sha256({_canonical_sql("text")}) d, min(license) license FROM r GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line FROM documents),
m AS MATERIALIZED (SELECT doc_id, k.license FROM (SELECT doc_id, sha256({_canonical_sql("line")}) d FROM l) x JOIN k ON k.d = x.d),
g AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) notices, count(*) n FROM m GROUP BY 1)
SELECT t.doc_id, k.license AS license, coalesce(g.notices, '') AS notices, coalesce(g.n, 0)::BIGINT AS n_notice_lines
FROM documents t LEFT JOIN k ON k.d = sha256({_canonical_sql("coalesce(t.text, '')")}) LEFT JOIN g ON g.doc_id = t.doc_id
"""


def _decontamination_sql() -> str:
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    size = decontamination.WINDOW
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {words.format(_LOWER.format("coalesce(text, '')"))} l FROM documents),
i AS (SELECT item_id::VARCHAR item, {words.format(_LOWER.format("coalesce(text, '')"))} l FROM benchmark),
v AS MATERIALIZED (SELECT DISTINCT item, len(l[k:k + {size - 1}]) m, l[k:k + {size - 1}] g FROM (SELECT item, l, unnest(range(1, greatest(1, len(l) - {size - 1}) + 1)) k FROM i WHERE len(l) > 0)),
z AS (SELECT DISTINCT m FROM v),
o AS (SELECT doc_id, l, m, unnest(range(1, len(l) - m + 2)) k FROM d JOIN z ON len(l) >= m),
h AS MATERIALIZED (SELECT o.doc_id, o.k, o.m, v.item FROM o JOIN v ON v.m = o.m AND v.g = o.l[o.k:o.k + o.m - 1]),
c AS (SELECT doc_id, count(DISTINCT w) n FROM (SELECT doc_id, unnest(range(k, k + m)) w FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) n, string_agg(DISTINCT item, ',' ORDER BY item) s FROM h GROUP BY 1)
SELECT d.doc_id, len(d.l)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.l) AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": _near_dedup_sql(), "op5_warc": _warc_sql(), "op6_license_scan": _license_sql(), "op9_decontamination": _decontamination_sql()}
