import zlib

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from loomgraph.llm import catalogue, near_dedup  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, each from its predecessor's result read back."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for df in stages[:-1]:
        assert df.dtypes == stages[0].dtypes
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_each_stage_only_drops_rows(stages):
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[-1] == ids[-2]


def test_one_document_of_each_group_stays(spark, stages):
    kept = {r.doc_id for r in stages[3].select("doc_id").collect()}
    groups = {r.component_id for r in near_dedup.near_duplicates(stages[2]).collect()}
    assert kept == groups


def test_folds_of_the_queries(spark):
    lang = {r.doc_id: r.held_out for r in catalogue.language_query(spark, SMALL).collect()}
    toxic = {r.doc_id: r.held_out for r in catalogue.toxicity_query(spark, SMALL).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in lang.items())
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in toxic.items())
    assert len(lang) == len(toxic) == 200


def test_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).selectExpr("*", "1 AS language", "2 AS Toxicity", "3 AS dropped", "'x' AS id", "'y' AS key", "0 AS node", "'h' AS host")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    assert corpus_pipeline.encode_pieces(spark, docs, SMALL).count() == 40


def test_verdicts_are_by_row(spark, tmp_path):
    passage = " ".join(f"q{k}" for k in range(20))
    spark.createDataFrame([(None, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = {k: " ".join(f"{k}w{i}" for i in range(30)) for k in "abcd"}
    rows = [(1, clean["a"]), (1, clean["a"]), (None, clean["a"]), (None, clean["b"]), (None, clean["b"]), (2, clean["c"]), (3, clean["c"]), (3, clean["d"]), (4, ""), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, table, str(tmp_path))
    assert kept.columns == ["doc_id", "text"]
    want = [(1, clean["a"]), (None, clean["b"]), (2, clean["c"]), (3, clean["d"]), (4, ""), (None, None)]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    table = spark.createDataFrame([(1, passage), (1, clean["a"]), (None, passage), (None, clean["b"])], "doc_id long, text string")
    kept = corpus_pipeline.drop_contaminated(spark, table, str(tmp_path))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, clean["a"]), (None, clean["b"])]))


def test_run_matches_brute_force(spark, stages):
    """The models' answers text by text, all pairs of shingle sets, all windows, and the library's own codec."""
    import hashlib
    import math

    import public_tokenizers
    import sentencepiece

    from loomgraph.llm import lang_id
    from tests.llm.test_operators import brute_components, brute_hits

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    languages = catalogue.language_model(docs)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    answers = languages.answers([t for _, t in rows], lang_id.WordRows(languages))
    rows = [r for r, a in zip(rows, answers, strict=True) if a[2]]
    toxic = catalogue.toxicity_model(stages[1], spark.read.parquet(f"{SMALL}/labels.parquet"))
    hits = toxic.hits()
    rows = [r for r in rows if 1 - math.prod(1 - p for _, p in toxic.sentences(r[1], hits)) < 0.5]
    rows = [r for r, c in zip(rows, brute_components([t for _, t in rows]), strict=True) if c[3]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [r for r, c in zip(rows, brute_hits([t for _, t in rows], items), strict=True) if not c[5]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(catalogue.TOKENIZER))
    want = []
    for i, t in rows:
        ids = library.encode(t)
        h = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want.append((i, len(ids), *h))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(want)
    assert 0 < len(want) < docs.count()


def test_empty_tables_and_null_texts(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, kind in (("labels", "doc_id long, quality long, toxic long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.isEmpty()
        none = docs.limit(0)
    odd = docs.limit(60).unionByName(docs.limit(3).selectExpr("doc_id + 1000 AS doc_id", "cast(null AS string) AS text", "lang", "source", "n_chars"))
    odd = odd.unionByName(docs.limit(3).selectExpr("doc_id + 2000 AS doc_id", "'' AS text", "cast(null AS string) AS lang", "source", "n_chars"))
    left = corpus_pipeline.identify_language(spark, odd, str(tmp_path))
    assert left.where("doc_id >= 1000").isEmpty()
    assert corpus_pipeline.drop_toxic(spark, odd, str(tmp_path)).count() == 66
    assert corpus_pipeline.drop_contaminated(spark, odd, str(tmp_path)).count() == 66
    assert corpus_pipeline.drop_near_duplicates(spark, odd, str(tmp_path)).where("doc_id >= 1000").count() == 6
    assert corpus_pipeline.encode_pieces(spark, odd, str(tmp_path)).where("n_tokens = 0").count() == 6
