import collections
import hashlib
import html
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomgraph.llm import (  # noqa: E402
    decontamination,
    html_text,
    lang_id,
    licenses,
    near_dedup,
    piece_codec,
    quality,
    token_counts,
    toxicity,
    warc,
)
from loomgraph.llm.common import Memo  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, `Text.x` string, id string, n int, key string"
LONG = " ".join(f"w{k % 701}" for k in range(30_000))
ODD = [
    None, "", " ", "\n", "a", "a  b", " lead", "trail ", "x\ny\n\nz", "▁", "a▁b", "日本語 テスト", "\x00\x01", "😀 é", "<s> <0x0A>", "  " * 40,
    "the cat sat on the mat and the dog sat on the log", "the cat sat on the mat and the dog sat on the log", LONG,
]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "q", "z", 1, "k") for i, t in zip(ids, texts, strict=True)], DOCS)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n, seed=0, alphabet="ab thein \n é▁1.,日😀"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def test_memo_forgets_and_recomputes():
    calls = []
    m = Memo(lambda k: calls.append(k) or (k * 2 + 1), 200 * Memo.PART)
    keys = list(range(1, 200)) * 2
    assert m.many(keys) == [k * 2 + 1 for k in keys]
    assert 0 < len(m.known) <= 200 * Memo.PART / (Memo.PLACE + 56) and len(calls) > 199 and m.room >= 0


def test_memo_is_bounded_in_bytes_by_long_keys():
    m = Memo(len, 1 << 20)
    m.many([f"{k}" * 1000 for k in range(1000, 3000)] + ["x" * (1 << 20)])
    assert 0 < sum(map(len, m.known)) < 1 << 20
    assert m["x" * (1 << 20)] == 1 << 20 and "x" * (1 << 20) not in m.known


# op1


def test_token_counts_match_the_library_and_fill_the_cache(spark, library, tmp_path):
    texts = ODD + random_texts(150)
    cache = str(tmp_path / "cache")
    d = docs(spark, texts)
    out = {r.id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(d, MODEL, cache=cache).collect()}
    assert out == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)}
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in texts})
    more = docs(spark, [*texts, "a new text"])
    assert token_counts.token_counts(more, MODEL, cache=cache).count() == len(texts) + 1
    assert spark.read.parquet(cache).count() == stored + 1


def test_cached_counts_are_used(spark, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts.token_counts(docs(spark, ["one two"]), MODEL, cache=cache).collect()
    path = str(tmp_path / "other")
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(99).cast("long")).write.parquet(path)
    assert [r.n_tokens for r in token_counts.token_counts(docs(spark, ["one two"] * 3), MODEL, cache=path).collect()] == [99] * 3


def test_token_counts_of_other_libraries_and_repeated_rows(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello there", "Hello there", None, "é 😀"]
    out = got(token_counts.token_counts(docs(spark, texts, [5, 5, 6, None]), path), "id", "n_tokens")
    t = Tokenizer.from_file(path)
    assert out == sorted(
        [(5, len(t.encode("Hello there").ids))] * 2 + [(6, 0), (None, len(t.encode("é 😀").ids))],
        key=lambda r: tuple((x is not None, str(type(x)), x) for x in r),
    )
    assert token_counts.tokenizer_version(path) != token_counts.tokenizer_version(MODEL)


def test_each_distinct_text_is_encoded_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    d = docs(spark, ["same text"] * 50 + ["other", "same text"], [1] * 50 + [1, None])
    assert token_counts.token_counts(d, MODEL, cache=cache).count() == 52
    assert spark.read.parquet(cache).count() == 2
    more = docs(spark, ["same text"] * 9 + ["new"] * 9, [1] * 18)
    assert token_counts.token_counts(more, MODEL, cache=cache).count() == 18
    assert spark.read.parquet(cache).count() == 3


def test_many_misses_are_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "FEW", 1)
    cache = str(tmp_path / "cache")
    token_counts.token_counts(docs(spark, ["a b", "c"]), MODEL, cache=cache).collect()
    assert token_counts.token_counts(docs(spark, ["a b", "d", "e", "e", None]), MODEL, cache=cache).count() == 5
    assert spark.read.parquet(cache).count() == 5


def test_empty_tables(spark):
    d = docs(spark, [])
    assert token_counts.token_counts(d, MODEL).isEmpty()
    assert near_dedup.near_duplicates(d).isEmpty()
    assert quality.judge_quality(d).isEmpty()
    assert piece_codec.piece_codes(d, MODEL).isEmpty()
    assert licenses.scan_licenses(d).isEmpty()
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminated(d, bench).isEmpty()
    assert not decontamination.decontaminated(docs(spark, ["a b"]), bench).first().contaminated
    assert lang_id.predict_languages(d, lang_id.fit(d.withColumn("lang", F.lit("en")))).isEmpty()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(d, toxicity.fit(d, labels)).isEmpty()
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


# op2


def brute_components(texts):
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    sets = []
    for t in texts:
        w = low(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if label[i] != label[j] and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [(i, len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, label, strict=True))]


def near_copies(seed=0):
    rnd = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = []
    for g in range(12):
        base = [f"b{g}x{k}" for k in range(rnd.randint(4, 90))]
        for _ in range(rnd.randint(1, 14)):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = f"c{rnd.randrange(10**6)}"
            texts.append(" ".join(w) + (f" {passage}" if rnd.random() < 0.4 else ""))
    texts += [f"only{k} {passage}" for k in range(25)] + ["A b C", "a B c", "a b", None, "", " \n"]
    return texts


def test_near_duplicates_match_brute_force(spark):
    texts = near_copies()
    out = near_dedup.near_duplicates(docs(spark, texts))
    assert got(out, "id", "n_shingles", "component_id", "kept") == brute_components(texts)


def test_prefix_join_misses_no_link(spark, monkeypatch):
    """Without any pivot's help, what is open goes through the exact join alone."""
    texts = near_copies(3)
    real = near_dedup._compared
    first = []

    def none_at_first(pairs, sets):
        first.append(1)
        return real(pairs, sets) if len(first) > 1 else real(pairs.limit(0), sets)

    monkeypatch.setattr(near_dedup, "_compared", none_at_first)
    out = near_dedup.near_duplicates(docs(spark, texts))
    assert got(out, "id", "n_shingles", "component_id", "kept") == brute_components(texts)


def test_repeated_ids_and_null_ids(spark):
    text = "one two three four five six seven"
    out = near_dedup.near_duplicates(docs(spark, [text, text, text, "else"], [7, 7, None, None]))
    assert got(out, "id", "component_id", "kept") == [(None, None, False), (None, 7, False), (7, 7, True), (7, 7, True)]


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.3, 0.75, 0.95):
        for n in (1, 7, 80, 3000):
            a = np.unique(rng.integers(0, 2**63, n).astype("uint64"))
            b = a.copy()
            b[: int(len(a) * (1 - share))] = rng.integers(0, 2**63, int(len(a) * (1 - share))).astype("uint64")
            b = np.unique(b)
            s = near_dedup.signatures([a, b])
            errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert max(map(abs, errors)) < 0.12
    assert (near_dedup.signatures([a])[0] == near_dedup.signatures([b[:3], a])[1]).all()


# op3 and op4


def made_up(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))


LANGS = {"aa": ["ka", "to", "mi", "ru"], "bb": ["schl", "ung", "eit", "ver"], "cc": ["ção", "lh", "ões", "qua"]}


def test_languages_on_held_out_texts(spark):
    rnd = random.Random(1)
    rows = [(k, made_up(rnd, LANGS[l], rnd.randint(1, 60)), l) for k, l in enumerate(rnd.choices(list(LANGS), k=600))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(table.where("doc_id < 400"))
    asked = table.where("doc_id >= 400")
    out = {r.id: r for r in lang_id.predict_languages(asked, model).collect()}
    assert np.mean([out[k].lang == l for k, _, l in rows[400:]]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    none = lang_id.predict_languages(docs(spark, [None, "", "123 !?", "  "]), model)
    assert {(r.lang, r.score, r.accepted) for r in none.collect()} == {("und", 0.0, False)}


def test_long_texts_are_used_whole():
    model = lang_id.LanguageModel(["a", "b"], np.random.default_rng(0).normal(size=(lang_id.BUCKETS, 3)).astype("float32"), np.zeros(3))
    rows = lang_id.WordRows(model, 50_000)
    words = LONG.split()
    one = rows.logits([LONG])[0]
    parts = np.array([rows.total([w])[0] for w in words[:701]]).sum(0)  # all kinds of words
    counts = collections.Counter(words)
    exact = sum(rows.total([w])[0].astype(float) * n for w, n in counts.items())
    assert np.allclose(one, exact[:-1] / exact[-1], atol=1e-4) and len(parts) == 4


def test_what_is_no_language_is_rejected(spark):
    rnd = random.Random(3)
    rows = [(k, made_up(rnd, LANGS[l], rnd.randint(2, 80)), l) for k, l in enumerate(rnd.choices(list(LANGS), k=900))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(table.where("doc_id < 600"))
    odd = ["1234 qqq zzzz xxxxx", "asdf qwerty uiop zxcv", "lkjsdf wpoeirj xcmvn qpwoe", "x7f9 2kd8 zz81 q0", "Привет как дела", "日本語のテキスト"]
    out = {r.id: r.accepted for r in lang_id.predict_languages(docs(spark, odd), model).collect()}
    assert not any(out.values())
    known = lang_id.predict_languages(table.where("doc_id >= 600"), model)
    assert known.where("accepted").count() >= 0.98 * 300


def test_language_training_uses_whole_texts_and_draws_repeated_rows_once(spark):
    """Two languages that begin alike differ only far behind; a third has few rows among copies of one."""
    rnd = random.Random(4)
    rows = [(k, made_up(rnd, LANGS["aa"], 1_500) + " " + made_up(rnd, LANGS[l], 1_500), l) for k, l in enumerate(["aa", "bb"] * 50)]
    rows += [(100, "lhção quaões", "cc")] * 300 + [(101, made_up(rnd, LANGS["cc"], 30), "cc")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(table, sample=120)
    assert model.langs == ["aa", "bb", "cc"]
    a, b = (made_up(rnd, LANGS["aa"], 1_500) + " " + made_up(rnd, LANGS[l], 1_500) for l in ("aa", "bb"))
    assert [x[0] for x in model.answers([a, b], lang_id.WordRows(model))] == ["aa", "bb"]
    again = lang_id.fit(table.repartition(7), sample=120)
    assert np.array_equal(model.table, again.table) and model.threshold == again.threshold


def test_quotas_are_even_and_bounded():
    assert lang_id.quotas({"a": 10_000, "b": 5, "c": 900}, 300) == {"b": 5, "c": 147, "a": 148}
    assert lang_id.quotas({"a": 3, "b": 4}, 100) == {"a": 3, "b": 4}
    assert lang_id.quotas({k: 9 for k in "abcd"}, 2) == {k: 1 for k in "abcd"}


def test_toxic_sentences_are_found(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for k in range(500):
        toxic = k % 5 == 0
        sentences = [made_up(rnd, LANGS["aa"], 8) for _ in range(rnd.randint(1, 12))]
        if toxic:
            at = rnd.randrange(len(sentences))
            sentences[at] += rnd.choice([" vile", " grimwald", " grimward"])
        rows.append((k, ". ".join(sentences)))
        labels.append((k, int(toxic)))
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, l.where("doc_id < 400"))
    out = {r.id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    assert all((out[k] >= 0.5) == bool(y) for k, y in labels if k >= 400)
    found = d.where("doc_id = 400").select(F.explode(toxicity.locator(spark, model)("text")).alias("s")).collect()
    assert len(found) == 1 and re.search("vile|grim", found[0].s.sentence)
    assert got(toxicity.score_toxicity(docs(spark, [None, ""]), model), "score") == [(0.0,), (0.0,)]
    # a very long clean text stays clean
    assert model.score(". ".join(["ka to mi"] * 100_000), model.hits()) < 0.5
    # a document's score is the noisy-or of the sentences that are told for it
    hits = model.hits()
    for t in [r[1] for r in rows] + ["ok.vile", "ok!vile?ka", "vile", "..vile\n", "ka.grimwald.to"] + random_texts(100, 3, "vile .!?\ngrimwald "):
        told = 1 - np.prod([1 - p for _, p in model.sentences(t, hits)])
        assert model.score(t, hits) == pytest.approx(told, abs=1e-12), t
    assert model.score("ok.vile", hits) > 0.5


def test_toxicity_learns_from_late_sentences_and_any_ids(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(60):
        late = made_up(rnd, LANGS["aa"], 9_000) + ". " + made_up(rnd, LANGS["aa"], 8)
        rows.append((f"id-{k}", late + (" vile. ka" if k % 3 == 0 else ". ka"), int(k % 3 == 0)))
    table = spark.createDataFrame([(*r, 1) for r in [*rows, rows[0]]], "doc_id string, text string, toxic int, sentences int")
    model = toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic"))
    out = {r.id: r.score for r in toxicity.score_toxicity(table, model).collect()}
    assert all((out[i] >= 0.5) == bool(y) for i, _, y in rows)
    # the bound on rows is kept whatever the balance of the classes
    rated = spark.createDataFrame([(k, int(k < 5)) for k in range(1000)], "id long, toxic int").withColumn("h", F.xxhash64("id"))
    drawn = {r.toxic: r["count"] for r in toxicity._drawn(rated, 100).groupBy("toxic").count().collect()}
    assert drawn == {1: 5, 0: 95}


def test_length_alone_is_not_toxic():
    model = toxicity.ToxicityModel({"vile ": 14.0})
    long = ". ".join(["ka to mi"] * 100_000)
    assert model.score(long, model.hits()) == 0 and model.score(long + ". vile", model.hits()) > 0.9
    weak = toxicity.ToxicityModel({"tame ": 2.0})
    assert weak.score(long + ". tame", weak.hits()) < 0.01


# op5


def test_archive_round_trip(spark, tmp_path):
    big = "<p>" + "é x " * 30_000 + "</p>"
    same = "y" * 200
    pages = [(3, "u3", same), (1, "u1", same), (2, None, same), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u7", big), (8, "u8", big), (9, "u9", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n"), (10, "u\r\n10", "z" * 5000)]
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    out = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert len(out) == len(pages)
    for i, _, h in pages:
        raw = (h or "").encode()
        assert bytes(out[i].payload) == raw and out[i].payload_bytes == len(raw)
        assert out[i].payload_digest == hashlib.sha256(raw).hexdigest()
    assert {i: out[i].refers_to for i in out if out[i].record_type == "revisit"} == {2: 1, 3: 1, 8: 7}


def test_repeated_pages_come_back(spark, tmp_path):
    big = "k" * 70_000
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", big), (1, "u", big), (None, "u", "t")], "page_id long, url string, html string"), path)
    assert got(warc.read_archive(spark, path), "page_id", "payload_bytes", "record_type") == [(None, 1, "response"), (1, 70_000, "response"), (1, 70_000, "response")]
    empty = str(tmp_path / "none")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archive(spark, empty).isEmpty()


def test_framing_and_damage():
    for n in (0, 1, warc.PLAIN, warc.PLAIN + 1, warc.CHUNK * 3 + 5):
        payload = bytes(k % 251 for k in range(n))
        assert warc.unframed(warc.framed(payload)) == payload
    with pytest.raises(ValueError):
        warc.unframed(warc.framed(b"x" * 9000).replace(b"\r\n2000\r\n", b"\r\n2001\r\n") + b"")
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    import pandas as pd

    block = warc.framed(b"q" * 90_000)
    told = "sha256:" + hashlib.sha256(b"q" * 90_000).hexdigest()
    rows = [("o", k + 1, 1, "u", "<urn:page:1:x>", told, None, block[at : at + 40_000], 1) for k, at in enumerate(range(0, len(block), 40_000))]
    names = ["origin", "number", "page_id", "url", "record", "digest", "total", "block", "copies"]
    with pytest.raises(ValueError, match="segments are missing"):
        warc._reassembled(True)(pd.DataFrame(rows[:-1], columns=names))
    rows[-1] = (*rows[-1][:6], len(block), *rows[-1][7:])
    assert warc._reassembled(True)(pd.DataFrame(rows[::-1], columns=names))["payload"][0] == b"q" * 90_000
    rows[0] = (*rows[0][:5], "sha256:" + "0" * 64, *rows[0][6:])
    with pytest.raises(ValueError, match="digest"):
        warc._reassembled(True)(pd.DataFrame([(*r[:5], rows[0][5], *r[6:]) for r in rows], columns=names))


def test_archives_of_other_writers(spark, tmp_path):
    """Other kinds of records, other digests and identifiers, gzipped members, segments out of order, a revisit of a record that is elsewhere."""
    import base64
    import gzip

    def rec(kind, rid, block, **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": rid, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(block)}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    http = lambda body: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4;x=y\r\nlong\r\n6\r\n  body\r\n0\r\nTrailer: t\r\n\r\n"
    plain = [
        rec("warcinfo", "<urn:uuid:0>", b"software: x\r\n", Content_Type="application/warc-fields"),
        rec("request", "<urn:uuid:r>", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        rec("response", "<urn:uuid:1>", http(b"one"), WARC_Target_URI="http://a/", WARC_Payload_Digest=sha1, Content_Type="application/http; msgtype=response"),
        rec("revisit", "<urn:uuid:2>", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Target_URI="http://b/", WARC_Refers_To="<urn:uuid:1>", WARC_Payload_Digest=sha1),
        rec("revisit", "<urn:uuid:3>", b"", WARC_Refers_To="<urn:uuid:nowhere>"),
        rec("continuation", "<urn:uuid:5>", chunked[50:], WARC_Segment_Origin_ID="<urn:uuid:4>", WARC_Segment_Number=2, WARC_Segment_Total_Length=len(chunked)),
        rec("metadata", "<urn:uuid:m>", b"x"),
    ]
    zipped = [rec("response", "<urn:uuid:4>", chunked[:50], WARC_Segment_Number=1, WARC_Payload_Digest="blake9:zz"), rec("response", "<urn:uuid:6>", b"bare", Content_Type="text/plain")]
    (tmp_path / "a.warc").write_bytes(b"".join(plain))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in zipped))
    out = {r.record[-2]: r for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert {k: (r.record_type, r.payload and bytes(r.payload), r.url) for k, r in out.items()} == {
        "1": ("response", b"one", "http://a/"), "2": ("revisit", b"one", "http://b/"), "3": ("revisit", None, None), "4": ("response", b"long  body", None), "6": ("response", b"bare", None),
    }
    assert out["2"].payload_digest == out["1"].payload_digest == hashlib.sha256(b"one").hexdigest() and out["1"].page_id is None
    (tmp_path / "a.warc").write_bytes(rec("response", "<urn:uuid:1>", http(b"two"), WARC_Payload_Digest=sha1))
    (tmp_path / "b.warc.gz").unlink()
    with pytest.raises(Exception, match="the payload has digest"):
        warc.read_archive(spark, str(tmp_path))


def test_pages_with_clashing_columns(spark, tmp_path):
    names = "page_id long, url string, html string, page int, record string, host string, low string, `a.b` string, digest int"
    rows = [(k, f"http://a.example/{k}", page(f"<article><p>{'text ' * (10 + k)}</p></article>"), 1, "r", "h", "l", "x", 2) for k in range(3)]
    pages = spark.createDataFrame(rows, names)
    warc.write_archive(pages, str(tmp_path / "a"))
    assert got(warc.read_archive(spark, str(tmp_path / "a")), "page_id", "url") == [(r[0], r[1]) for r in rows]
    assert got(html_text.extract_text(pages), "id", "text") == [(k, ("text " * (10 + k)).strip()) for k in range(3)]


# op6


def test_licences(spark):
    texts = [
        "Copyright (c) 2020 Some One\n" + licenses.MIT.upper(),
        "intro\nLICENSED under CC-BY-NC 4.0!\nmore\nReleased under the MIT licence\n  Licensed under the MIT License.",
        "licence plates and public domain songs",
        None,
        "",
        "This work is licensed under the GNU GPL, version 3.",
        LONG,
    ]
    out = got(licenses.scan_licenses(docs(spark, texts)), "id", "license", "notices", "n_notice_lines")
    # MIT's own text has no line that is a notice by itself
    assert out == [
        (0, "MIT", "", 0), (1, None, "CC-BY-NC-4.0,MIT", 3), (2, None, "", 0), (3, None, "", 0), (4, None, "", 0), (5, "GPL-3.0", "GPL-3.0", 1), (6, None, "", 0),
    ]


def test_notices_in_words_of_equivalent_spellings(spark):
    lines = ["Released under CC BY 4.0.", "Released under CC BY-NC 4.0.", "Released under Creative Commons Attribution 4.0", "Released under the GNU GPL, version 3."]
    out = got(licenses.scan_licenses(docs(spark, [*lines, "intro\n" + "\n".join(lines) + "\nend"])), "id", "license", "notices", "n_notice_lines")
    names = ["CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-4.0", "GPL-3.0"]
    assert out == [*[(k, x, x, 1) for k, x in enumerate(names)], (4, None, "CC-BY-4.0,CC-BY-NC-4.0,GPL-3.0", 4)]


def test_canonical_form_of_adjacent_spellings(spark):
    texts = ["licence licence a", "Released under released under licence licenced", "GNU  GPL gnu-gpl version\nversion"]
    out = [r[0] for r in docs(spark, texts).orderBy("doc_id").select(licenses.canonical(F.col("text"))).collect()]
    assert out == ["license license a", "licensed under licensed under license licensed", "gnu general public license gnu general public license v v"]


def test_canonical_forms_match_brute_force(spark):
    def brute(t):
        lines = [x for x in t.lower().split("\n") if not re.fullmatch(licenses.COPYRIGHT.removeprefix("(?m)^").removesuffix("$"), x)]
        words = re.findall("[a-z0-9]+", "\n".join(lines))
        for old, new in licenses.SPELLINGS:
            o, n, out, k = old.split(), new.split(), [], 0
            while k < len(words):
                hit = words[k : k + len(o)] == o
                out += n if hit else words[k : k + 1]
                k += len(o) if hit else 1
            words = out
        return " ".join(words)

    rnd = random.Random(13)
    parts = ["licence", "Licenced", "released", "under", "creative commons", "attribution", "sharealike", "non", "commercial", "version", "gnu", "gpl", ",", "\n", "x1", "Copyright 2020 A", "(c) all rights reserved", "non-infringement", "sub license"]
    texts = ["".join(rnd.choice(parts) + rnd.choice([" ", "  ", "\n", "-"]) for _ in range(rnd.randint(1, 25))) for _ in range(200)] + [licenses.MIT, licenses.ISC]
    out = [r[0] for r in docs(spark, texts).orderBy("doc_id").select(licenses.canonical(F.col("text"))).collect()]
    assert out == [brute(t) for t in texts]


def test_whole_licences(spark):
    folder = Path(licenses.__file__).parent / "license_texts"
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"]
    texts = [(folder / f"{n}.txt").read_text() for n in names]
    filled = texts[0].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Some One").replace("http:", "https:")
    bare = "Copyright (c) 2001, Some One\nAll rights reserved.\n\n" + texts[2][texts[2].index("Redistribution") :].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    more = [filled, bare, "Copyright 2020 Some One\n" + licenses.MIT.split("\n", 1)[1], texts[0] + "\nand more"]
    out = {r.id: r.license for r in licenses.scan_licenses(docs(spark, texts + more)).collect()}
    assert [out[k] for k in range(len(out))] == [*names, "Apache-2.0", "BSD-3-Clause", "MIT", None]


# op7


def page(article, extra=""):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>Home<li>News</ul></nav>{extra}{article}<footer>&copy; us</footer></body></html>"


def test_main_text_blocks():
    art = '<article class="post"><header><h1>Title &amp; more</h1></header><p><b>One<br>two<p>Thr&eacute;e <i>x</i>\n\t y</p><script>var a="</p>"</script><aside>cut</aside><div class="comments"><p>me too</p></div><ul><li>a<li>b</ul></article>'
    assert html_text.main_text(page(art)) == ["Title & more", "One two", "Thrée x y", "a", "b"]
    assert html_text.main_text(page("<div><p>no article</p><form>f</form><p style='display:none'>h</p></div>")) == ["no article"]
    assert html_text.main_text(None) == html_text.main_text("") == []
    assert html_text.main_text("plain & simple <b>x</b> <a href='") == ["plain & simple x"]
    assert html_text.main_text("<article><p>cut &am") == ["cut &am"]
    assert html_text.main_text("<p>" * 3000 + "deep") == ["deep"]


def test_style_tree_cuts_a_hosts_template(spark):
    rows = []
    for k in range(20):
        body = f'<div class="box"><p>Welcome to our site</p></div><div class="text"><p>story {k} {"x" * k}</p><p>other {k * 7}</p></div>'
        rows.append((k, f"http://a.example/{k}", page(body)))
    rows += [(100, "http://b.example/1", page('<div class="box"><p>Welcome to our site</p></div>')), (101, None, None), (102, "http://a.example/1", "")]
    out = {r.id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "story 3 xxx\n\nother 21"
    assert out[100] == "Welcome to our site" and out[101] == out[102] == ""


def test_articles_on_pages_like_the_test_tables():
    for t in random_texts(50, 4, "ab <>&\n é."):
        body = f"<article><h1>h</h1><p>{html.escape(t)}</p></article>"
        want = " ".join(t.split())
        assert html_text.main_text(page(body)) == ["h", *([want] if want else [])]


def test_the_tree_cuts_inside_articles_and_leaves_copies(spark):
    rows = []
    for k in range(20):
        own = f'<div class="box"><p>Welcome to our site</p></div><div class="text"><p>story {k} {"x" * k} of the day</p><p>other words {k * 7}</p></div>'
        rows += [(k, f"http://a.example/{k}", page(f"<main>{own}</main>")), (k + 50, f"http://b.example/{k}", page(f"<article>{own}</article>"))]
        rows.append((k + 100, f"http://c.example/{k}", page("<article><h1>Same title</h1><p>A copied article with its own words</p></article>")))
    out = {r.id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == out[53] == "story 3 xxx of the day\n\nother words 21"
    assert {out[k + 100] for k in range(20)} == {"Same title\n\nA copied article with its own words"}


def brute_tree(rows):
    """host, path to seen and importance, by loops over the pages."""
    import math

    texts, styles = collections.defaultdict(list), collections.defaultdict(list)
    for host, html_ in rows:
        walk = html_text.Walk(html_ or "")
        for path, _, main, _, text in walk.found:
            for p in {path} if main else {path, html_text.branch(path)}:
                texts[host, p].append(text)
        for path, children in walk.styles:
            styles[host, path].append(children)

    def entropy(found):
        n = len(found)
        return 1.0 if n == 1 else -sum(k / n * math.log(k / n) for k in collections.Counter(found).values()) / math.log(n)

    out = {}
    for key, found in texts.items():
        content = entropy(found)
        mean = 0.75 * content + 0.25 * (entropy(styles[key]) if key in styles else content)
        out[key] = (len(found), round((len(found) * mean + 1) / (len(found) + 1), 9))
    return out


def small_hosts():
    rnd = random.Random(14)
    rows = []
    for k in range(40):
        own = f'<div class="box"><p>Welcome</p></div><div class="text">{"".join(f"<p>{made_up(rnd, LANGS["aa"], 4)}</p>" for _ in range(rnd.randint(1, 3)))}</div><div class="foot"><p>{rnd.choice(["x", "y"])}</p></div>'
        rows.append((f"{'abc'[k % 3]}.example", page(rnd.choice(["{}", "<main>{}</main>"]).format(own))))
    return [*rows, ("d.example", ""), ("d.example", None), ("e.example", "<p>once</p>")]


def test_style_tree_matches_brute_force(spark):
    rows = small_hosts()
    out = html_text.style_tree(spark.createDataFrame(rows, "host string, html string")).collect()
    assert {(r.host, r.path): (r.seen, round(r.importance, 9)) for r in out} == brute_tree(rows)


def test_the_tree_decides_and_needs_no_fixed_number_of_pages(spark):
    """Without the tree the template stays; with it three pages are enough, and two are not."""
    body = lambda k: f'<div class="box"><p>Welcome to our site</p></div><div class="text"><p>story {k} {"x" * (k + 5)} of this one day</p></div>'
    rows = [(k, f"http://{h}.example/{k}", page(body(k))) for h, n in (("a", 3), ("b", 2)) for k in range(n)]
    out = html_text.extract_text(spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "page_id long, url string, html string"))
    texts = [r.text for r in out.orderBy("id").collect()]
    story = lambda k: f"story {k} {'x' * (k + 5)} of this one day"
    assert texts == [*map(story, range(3)), *(f"Welcome to our site\n\n{story(k)}" for k in range(2))]
    assert html_text.main_text(rows[0][2]) == ["Welcome to our site", story(0)]


def test_hosts_with_many_low_paths_look_up_their_own(spark):
    rows = [(k, f"http://{h}/{k}", x) for k, (h, x) in enumerate(small_hosts())] + [(k + 100, f"http://a.example/{k}", None) for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = got(html_text.extract_text(pages), "id", "text")
    assert got(html_text.extract_text(pages, most_paths=0), "id", "text") == want
    assert any("Welcome" not in t and t for _, t in want)


def test_copied_pages_keep_their_text(spark):
    rows = [(k, f"http://a.example/{k}", page('<div class="text"><h1>Title</h1><p>A long copied text in plain divs</p><p>and more of it</p></div>')) for k in range(12)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("A long copied text in plain divs\n\nand more of it" in r.text for r in out)


def test_a_very_long_page():
    paragraphs = [f"Paragraph {k} of a long page" for k in range(30_000)]
    assert html_text.main_text(page("<article>" + "".join(f"<p>{p}" for p in paragraphs) + "</article>")) == paragraphs


def test_cards_and_comments_are_not_the_article():
    body = "<div><h1>Title</h1>" + "".join(f"<p>Paragraph {k} of a body in plain divs</p>" for k in range(5)) + "</div>"
    want = ["Title", *(f"Paragraph {k} of a body in plain divs" for k in range(5))]
    assert html_text.main_text(page(body + "<article class='teaser'><p>Read this too</p></article>")) == want
    assert html_text.main_text(page(body + "<article><p>Read this too</p></article>")) == [*want, "Read this too"]
    comments = "<article class='comment'><p>A reader says</p></article>" * 3
    assert html_text.main_text(page(body + comments)) == want
    assert html_text.main_text(page(f"<article>{body}</article>{comments}")) == want


def test_words_of_classes_are_evidence():
    body = "<h1>Title</h1><p>One paragraph of the page</p><p>Another one</p>"
    want = ["Title", "One paragraph of the page", "Another one"]
    for mark in ("class='layout has-sidebar'", "class='content no-sidebar'", "class='sidebar'", "id='social'"):
        for inner in (f"<article>{body}</article>", body):
            assert html_text.main_text(page(f"<div {mark}>{inner}</div>")) == want, (mark, inner)
    kept = "<section id='related-work'><h2 id='social-impact'>A</h2><p>b</p></section><div class='entry-header'>c</div><section id='copyright'><p>d</p></section>"
    cut = "<div class='sidebar'>x</div><div class='comments'>" + "<p>a long comment of a reader</p>" * 40 + "</div>"
    assert html_text.main_text(page(f"<article>{body}{kept}{cut}</article><div class='ad'>{'buy ' * 50}</div>")) == [*want, "A", "b", "c", "d"]


# op8


def brute_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_measures_match_brute_force():
    texts = [t or "" for t in ODD] + random_texts(300, 5, "ab  \n#*| é") + ["x y z p q " * 3, "a a a a a a", "a\na\n a\n\nb\nb"]
    for t in texts:
        assert quality.measures(t)[:5] == brute_measures(t), repr(t[:80])


def test_quality_verdicts(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice(["ka", "to", "mi", "ru", "sel", "por"]) for _ in range(rnd.randint(1, 4)))
    good = [" ".join(word() for _ in range(80)) for _ in range(200)]
    symbols = [" ".join(word() + "***" for _ in range(80)) for _ in range(15)]
    shouted = [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(15)]
    out = quality.judge_quality(docs(spark, good + symbols + shouted + ["few words", None]))
    kept = [r.kept for r in out.orderBy("id").collect()]
    assert all(kept[:200]) and not any(kept[200:])
    assert out.where("id = 230").first().base_failed


def test_a_lone_bad_vote_does_not_decide(spark):
    """Headings and compounds draw one rule's bad vote; junk draws several. Verdicts are not those of an all-must-pass filter."""
    rnd = random.Random(8)
    word = lambda n=4: "".join(rnd.choice(["ka", "to", "mi", "ru", "sel", "por"]) for _ in range(rnd.randint(1, n)))
    text = lambda make: " ".join(make() for _ in range(80))
    good = [text(word) for _ in range(400)]
    headings, compounds = [text(lambda: word().upper()) for _ in range(50)], [text(lambda: "kator" * 4 + word()) for _ in range(15)]
    junk = [text(lambda: word() + "***") for _ in range(25)] + [" ".join(f"{word()} |" for _ in range(80)) for _ in range(25)]
    by = quality.rules()
    table = quality.measured(docs(spark, headings + compounds))
    votes = table.select(*[r.vote().alias(r.name) for r in by]).distinct().collect()
    assert {sum(v == quality.BAD for v in r) for r in votes} == {1}
    kept = [r.kept for r in quality.judge_quality(docs(spark, good + headings + compounds + junk)).orderBy("id").collect()]
    assert all(kept[:465]) and not any(kept[465:])


def brute_verdicts(texts):
    """Votes and expectation-maximisation by loops over documents, not patterns."""
    import math

    def votes(t):
        w, n_words, chars = t.split(" ") if t else [], *brute_measures(t)[:2]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n_symbols, n_repeat = brute_measures(t)[2], brute_measures(t)[4]
        if n_words < 10:
            return [0] * 8
        upper, lower = (sum(c in quality.UPPER.decode() for c in t), sum(c in quality.LOWER.decode() for c in t))
        cut = n_words // 50 * 50 or n_words
        kinds = sum(len(set(w[k : min(cut, k + 50)])) for k in range(0, cut, 50))
        marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in t)
        found = [
            (n_symbols / n_words, 0.1, 0.5), (n_repeat / n_words, 0.1, 0.2), (upper / max(1, upper + lower), 0.3, 0.5), (sum(len(x.encode()) < 4 and not any(c.isalnum() for c in x) for x in w) / n_words, 0.05, 0.15),
            (1 - kinds / cut, 0.5, 0.7), (chars / n_words, 10, 15), (sum(bool(set(x) & set("#*$%&|<>")) for x in w) / n_words, 0.1, 0.3), (marks / max(1, chars), 0.1, 0.2),
        ]
        return [1 if v < good else -1 if v > bad else 0 for v, good, bad in found]

    every = [votes(t or "") for t in texts]
    start = {"good": (0.99, 0.01), "bad": (0.55, 0.45)}
    rates, prior = {c: [start[c]] * 8 for c in start}, 0.85

    def chance(v):
        odds = math.log(prior / (1 - prior))
        for k, x in enumerate(v):
            if x:
                odds += math.log(rates["good"][k][x < 0] / rates["bad"][k][x < 0])
        return 1 / (1 + math.exp(-odds))

    for _ in range(200):
        z = [chance(v) for v in every]
        for c in start:
            weight = z if c == "good" else [1 - x for x in z]
            new = []
            for k in range(8):
                up, down = (sum(x for x, v in zip(weight, every, strict=True) if v[k] == s) for s in (1, -1))
                new.append(tuple((y + 50 * b) / (up + down + 50) for y, b in zip((up, down), start[c], strict=True)))
            rates[c] = new
        prior, before = (sum(z) + 50 * 0.85) / (len(z) + 50), prior
        if abs(prior - before) < 1e-9:
            break
    return [(not (len((t or "").split()) < 10 or 100 * brute_measures(t or "")[4] > 20 * len((t or "").split())) and chance(v) >= 0.5, chance(v)) for t, v in zip(texts, every, strict=True)]


def test_verdicts_match_brute_force(spark):
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice(["ka", "to", "mi", "ru", "sel", "por"]) for _ in range(rnd.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rnd.randint(1, 150))) for _ in range(120)]
    for make in (lambda: word() + "***", lambda: word().upper(), lambda: "|", lambda: word() * 4, lambda: "ka", lambda: word() + ".,"):
        texts += [" ".join(make() if rnd.random() < rnd.choice([0.2, 0.6, 1.0]) else word() for _ in range(rnd.randint(8, 120))) for _ in range(8)]
    texts += [None, "", texts[3], texts[3]]
    out = quality.judge_quality(docs(spark, texts)).orderBy("id").collect()
    want = brute_verdicts(texts)
    assert [r.kept for r in out] == [k for k, _ in want]
    assert [r.quality for r in out] == pytest.approx([p for _, p in want], abs=1e-6)
    assert 0 < sum(r.kept for r in out) < len(texts)


def test_few_kinds_of_words_are_seen_at_any_length(spark):
    rnd = random.Random(16)
    kinds = [f"ka{k}" for k in range(6)]
    texts = [" ".join(rnd.choice(x) for _ in range(n)) for x in (kinds, [f"to{k}" for k in range(400)]) for n in (60, 1_999, 2_000, 20_000)]
    (rule,) = [r for r in quality.rules() if r.name == "few_kinds"]
    votes = [r[0] for r in quality.measured(docs(spark, texts)).orderBy("id").select(rule.vote()).collect()]
    assert votes == [quality.BAD] * 4 + [quality.GOOD] * 4


def test_one_bad_vote_lies_on_both_sides():
    """With good votes of rules that are seldom wrong it is a rule's error; with silence around it, it is not."""
    junk, alone, other, among = [-1, -1, 0, 0, 0, 0, 0, 0], [-1, 0, 0, 0, 0, 0, 0, 0], [0, -1, 0, 0, 0, 0, 0, 0], [-1, 1, 1, 1, 1, 1, 1, 1]
    votes = np.array([[1] * 8, junk, alone, other, among, [-1, 1, 1, 0, 0, 0, 0, 0]])
    model = quality.expectation_maximisation(votes, np.array([8000.0, 600, 60, 60, 100, 0]))
    z = model.log_odds(votes)
    assert z[0] > 0 and z[1] < z[2] < 0 and z[3] < 0 < z[4] and z[2] < z[5] < z[4]


def test_rates_of_good_documents_are_estimated():
    patterns = np.array([[1] * 8, [-1, 1, 1, 1, 1, 1, -1, -1], [0, 1, 1, -1, 1, 1, -1, 0]])
    for lone in range(8):
        for n in (300, 1000):
            votes = np.vstack([patterns, np.where(np.arange(8) == lone, -1, 1)])
            model = quality.expectation_maximisation(votes, np.array([8000.0, 330, 320, n]))
            good = model.log_odds(votes) > 0
            assert good.tolist() == [True, False, False, True] and model.rates[1, lone, 1] > 0.01


# op9


def brute_hits(texts, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = []
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for x in {len(x) for x in windows}:
                if tuple(w[k : k + x]) in windows and k + x <= len(w):
                    hit |= set(range(k, k + x))
                    found |= windows[tuple(w[k : k + x])]
        out.append((d, len(w), len(hit), len(found), decontamination.items_digest(list(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def contaminated_case():
    rnd = random.Random(7)
    word = lambda: rnd.choice(["the", "cat", "dog", "é", "ran", "7", "Of", "it"])
    items = [(k, " ".join(word() for _ in range(rnd.choice([1, 2, 5, 12, 13, 14, 40])))) for k in range(1, 30)]
    items += [(40, items[3][1]), (41, ""), (42, None), (43, "...")]
    texts = [None, "", "the", "THE-cat; dog"]
    for _ in range(60):
        w = [word() for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.6:
            at = rnd.randint(0, len(w))
            w[at:at] = (rnd.choice(items)[1] or "").split()
        texts.append(" ".join(w))
    return texts, items


@pytest.mark.parametrize("bits", [decontamination.MOST_BITS, 64])
def test_decontamination_matches_brute_force(spark, bits):
    """Also with a filter so small that every shingle passes it."""
    texts, items = contaminated_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.decontaminated(docs(spark, texts), bench, most_bits=bits)
    assert got(out, "id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_hits(texts, items)


def test_repeated_rows_come_back_with_their_ranges(spark):
    texts, items = contaminated_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    passage = " ".join(f"q{k}" for k in range(20))
    d = docs(spark, [texts[10], texts[10], texts[11], passage + " x " + passage, passage + " x " + passage], [1, 1, 1, None, None])
    out = got(decontamination.contamination(d, bench.union(spark.createDataFrame([(90, passage)], bench.schema))), "id", "n_words", "n_hit", "items", "ranges")
    assert len(out) == 5 and len({str(r) for r in out}) == 3
    assert out[0] == (None, 41, 40, ["90"], [[0, 20], [21, 41]])


def test_blocks_of_words_do_not_matter(spark, monkeypatch):
    texts, items = contaminated_case()
    index = decontamination.Filter(1 << 10, [1, 5])
    index.map[:] = 255
    words = decontamination.tokens(" ".join(t or "" for t in texts))
    whole = [(size, at.tolist()) for size, at, _ in index.found(words, decontamination._left(np.array([len(words)])))]
    assert whole == [(1, list(range(len(words)))), (5, list(range(len(words) - 4)))]
    monkeypatch.setattr(decontamination, "BLOCK", 7)
    parts = list(decontamination._blocks(texts))
    assert sum((list(n) for _, _, n in parts), []) == [len(decontamination.tokens(t)) for t in texts]
    assert [k for k, _, _ in parts] == list(np.cumsum([0] + [len(n) for _, _, n in parts])[:-1])


def test_items_without_an_id_count_for_hit_words(spark):
    bench = spark.createDataFrame([(None, "the cat"), (None, "a dog"), (1, "the bird")], "item_id long, text string")
    out = decontamination.decontaminated(docs(spark, ["the cat and a dog", "the bird", "the end"]), bench)
    assert got(out, "id", "n_hit", "n_items", "contaminated") == [(0, 4, 0, True), (1, 2, 1, True), (2, 0, 0, False)]


# op10


def test_codec_matches_the_library(spark, library):
    texts = ODD + random_texts(400, 8)
    own = piece_codec.PieceCodec(MODEL)
    for t in texts:
        ids = library.encode(t or "")
        assert own.encode(t or "") == ids, repr(t)
        assert own.decode(ids) == library.decode(ids), repr(t)
    out = got(piece_codec.piece_codes(docs(spark, texts), MODEL), "id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded")
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, n, a, b, decoded in out:
        ids = library.encode(texts[i] or "")
        assert (n, a, b) == (len(ids), h(",".join(map(str, ids))), h(library.decode(ids))) and decoded == library.decode(ids)


def test_backtracking_agrees_with_merging():
    own = piece_codec.PieceCodec(MODEL)
    for t in random_texts(300, 9, "abcdeinrst▁."):
        assert [own.piece[i] for i in own._covered(t)] == own.merged(t)


def test_a_long_line_without_spaces(library):
    own = piece_codec.PieceCodec(MODEL)
    rnd = random.Random(11)
    for text in ("".join(rnd.choice("abcdeinrst日é") for _ in range(20_000)), "ab" * 30_000 + "\n" + "q" * 5_000):
        ids = library.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids) == text


def test_decoding_looks_at_the_ids_only(library):
    own = piece_codec.PieceCodec(MODEL)
    rnd = random.Random(12)
    some = list(own.piece) + list(own.byte.values())
    for _ in range(300):
        ids = [rnd.choice(some) for _ in range(rnd.randint(1, 12))]
        assert own.decode(ids) == library.decode(ids), ids
    parts = own.parts("one two\nthree")
    assert own.decoded(parts[:2]) == "one two" and own.decoded([]) == ""


def test_bytes_that_spell_nothing_are_replaced(library):
    own = piece_codec.PieceCodec(MODEL)
    ids = [own.byte[0xE6], own.byte[0x97], own.id["a"], own.byte[0xFF]]
    assert own.decode(ids) == library.decode(ids)


def test_fold_is_crc32_of_the_text(spark):
    from loomgraph.llm.common import crc_fold

    rows = spark.range(50).select("id", crc_fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_a_worker_holds_one_operators_tables_at_a_time():
    from loomgraph.llm.common import held

    first = held("a", list)
    assert held("a", list) is first
    held("b", dict)
    assert held("a", list) is not first
