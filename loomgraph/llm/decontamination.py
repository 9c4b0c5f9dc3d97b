"""Benchmark decontamination: a prefix-filtered join of document shingles with benchmark windows, verified exactly.

An item's windows are its runs of 13 words; a shorter item is one window. A window occurs in a document only if all its
shingles of five words do, in place (a window of fewer words is one shingle). So of each window only the rarest shingle, by document counts over the whole
corpus, is joined: for exact containment the necessary prefix is that one. Windows of which some shingle is in no document drop out. Where
a prefix occurs, its place in the window gives the only possible start, which must lie in the document with the whole window (position and length bounds);
then the words are compared.

Windows, shingles, counts and candidates are tables, joined by shuffles unless they are small. What executors get is a bitmap of the shingles, in a Bloom filter's manner, of MOST_BITS
bits at most whatever the benchmark's size: it spares the joins the shingles that no window has. A benchmark too large for it makes the filter weaker, never the result.

Rows: null and empty texts have no words, and an item without words matches nothing. Items of equal text each count; one without
an id counts for the hit words, but is no item that could be named. Repeated rows each come back, with equal results. A document
of any length is matched whole. An empty benchmark leaves every document clean; an empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import GOLDEN, LOWER_ALNUM, mix, named
from loomgraph.runtime import discard, written

WINDOW, SHINGLE = 13, 5
#: Bits of the filter: at least, at most (32 MiB), and for each shingle.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 22, 1 << 28, 64
#: Bits of a row of Spark's bitmap aggregate.
BUCKET = 8 * 4096
#: Words of documents that are looked at together.
BLOCK = 200_000


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode().translate(LOWER_ALNUM).split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype="uint64", count=len(words))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` words, by their hashes and the size."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, dtype="uint64")
    for k in range(size):
        out = out * GOLDEN + h[k : k + n]
    return mix(out).view("int64")


def _windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of an item with the digest that names it, its words and its shingles."""
    import xxhash

    for f in frames:
        rows: list[tuple] = []
        for item, text in zip(f["id"], f["text"], strict=True):
            w = tokens(text)
            size = min(WINDOW, len(w))
            own = shingles(hashes(w), min(SHINGLE, size)) if w else None
            for k in range(len(w) - size + 1 if w else 0):
                words = b" ".join(w[k : k + size])
                rows.append((xxhash.xxh3_128_digest(words), item, size, words.decode(), own[k : k + size - min(SHINGLE, size) + 1]))
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=_WINDOW)
                    rows = []
        yield pd.DataFrame(rows, columns=_WINDOW)


_WINDOW = ["window", "item", "size", "words", "shingles"]


class Filter:
    """A bitmap of shingles, two bits each, and the sizes of the shingles that it has."""

    def __init__(self, bits: int, sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.map = np.zeros(max(1, bits // 8), dtype="uint8")

    def has(self, s: np.ndarray) -> np.ndarray:
        out = None
        for place in (s & np.int64(self.bits - 1), (s.view("uint64") >> np.uint64(32)).view("int64") & np.int64(self.bits - 1)):
            hit = (self.map[place >> 3] >> (place & 7).astype("uint8")) & 1
            out = hit if out is None else out & hit
        return out.astype(bool)

    def found(self, words: list[bytes], left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per size the places of runs that may be shingles of a window, and their numbers. ``left``: words to the end of each word's document."""
        h = hashes(words)
        for size in self.sizes:
            s = shingles(h, size)
            at = np.flatnonzero(self.has(s) & (left[: len(s)] >= size))
            yield size, at, s[at]


def _filter(found: DataFrame, most_bits: int) -> Filter:
    """Of a table (size, shingle, ...). The rows that reach the driver are MOST_BITS bits together at most."""
    seen = found.groupBy("size").agg(F.count("*").alias("n")).collect()
    bits = min(most_bits, max(LEAST_BITS, 1 << (BITS_EACH * sum(r.n for r in seen)).bit_length()))
    out = Filter(bits, sorted(r.size for r in seen))
    s = F.col("shingle")
    place = F.explode(F.array(s.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(s, 32).bitwiseAND(F.lit(bits - 1)))).alias("place")
    rows = found.select(place).select((F.col("place") + 1).alias("place"))  # Spark's buckets count from 1
    rows = rows.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    for r in rows.collect():
        part = np.frombuffer(r.map, dtype="uint8")
        at = (r.bucket - 1) * BUCKET // 8
        n = min(len(part), len(out.map) - at)
        out.map[at : at + n] |= part[:n]
    return out


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Runs of texts of about BLOCK words together: the first text's place, all words, and the number of words of each."""
    first, words, sizes = 0, [], []
    for k, t in enumerate(texts):
        own = tokens(t)
        words += own
        sizes.append(len(own))
        if len(words) >= BLOCK or k == len(texts) - 1:
            yield first, words, np.array(sizes, dtype="int64")
            first, words, sizes = k + 1, [], []


def _left(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())


def _document_counts(rows: DataFrame, index: Filter) -> DataFrame:
    """shingle, n: how many rows have it, of those that pass the filter; added up per batch before they move."""
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for f in frames:
            for _, words, sizes in _blocks(f["text"].tolist()):
                owner = np.repeat(np.arange(len(sizes)), sizes)
                for _, at, s in own.found(words, _left(sizes)):
                    order = np.lexsort((owner[at], s))
                    s, by = s[order], owner[at][order]
                    new = np.ones(len(s), dtype=bool)
                    new[1:] = (s[1:] != s[:-1]) | (by[1:] != by[:-1])
                    kinds, n = np.unique(s[new], return_counts=True)
                    yield pd.DataFrame({"shingle": kinds, "n": n})

    return rows.select("text").mapInPandas(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _candidates(rows: DataFrame, index: Filter) -> DataFrame:
    """id, key, n_words per row of id, text, and where prefixes may occur: shingle, place, and the words that a window there could have, from ``first`` on."""
    sent = rows.sparkSession.sparkContext.broadcast(index)
    kind = rows.schema["id"].dataType.simpleString()

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        own = sent.value
        for f in frames:
            texts = f["text"].tolist()
            n_words = np.zeros(len(texts), dtype="int64")
            found: list[list[dict]] = [[] for _ in texts]
            for first, words, sizes in _blocks(texts):
                n_words[first : first + len(sizes)] = sizes
                ends = np.cumsum(sizes)
                for size, at, s in own.found(words, _left(sizes)):
                    docs = np.searchsorted(ends, at, side="right")
                    for d, a, x in zip(docs.tolist(), at.tolist(), s.tolist(), strict=True):
                        start = int(ends[d] - sizes[d])
                        lo, hi = (max(start, a - WINDOW + size), min(int(ends[d]), a + WINDOW)) if size == SHINGLE else (a, a + size)
                        found[first + d].append({"shingle": x, "place": a - start, "first": lo - start, "words": b" ".join(words[lo:hi]).decode()})
            keys = [xxhash.xxh3_128_digest(t.encode() if t else b"") for t in texts]
            yield pd.DataFrame({"id": f["id"], "key": keys, "n_words": n_words, "found": found})

    return rows.mapInPandas(search, f"id {kind}, key binary, n_words long, found array<struct<shingle: long, place: long, first: long, words: string>>")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """id, n_words, n_hit, n_items, items (sorted ids as strings) and ranges of hit words per row.

    The documents are read twice: for the counts, and for the candidates. Rows of one id are told apart by the digest of their text, and equal rows share a
    result. Grouped tables are written before they are joined, so that the engine may split a hot key.
    """
    rows = named(docs, id=id_col, text=text_col)
    items = named(benchmark, id=item_col, text=item_text_col).select(F.col("id").cast("string").alias("id"), "text").where("text IS NOT NULL")
    made = written(items.mapInPandas(_windows, "window binary, item string, size int, words string, shingles array<long>"), "windows")
    owners = made.where("item IS NOT NULL").select("window", "item").distinct()
    kinds = made.groupBy("window").agg(*[F.first(c).alias(c) for c in ("size", "words", "shingles")])
    each = kinds.select("window", "size", "words", F.posexplode("shingles").alias("offset", "shingle"))
    each = written(each, "shingles")

    size = F.least("size", F.lit(SHINGLE)).alias("size")
    counts = _document_counts(rows, _filter(each.select(size, "shingle").distinct(), most_bits))
    rated = each.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # among equally rare ones the least number, so that windows that overlap choose alike
    prefix = rated.groupBy("window").agg(F.min(F.struct("n", "shingle", "offset")).alias("p"), F.first("size").alias("size"), F.first("words").alias("words"))
    prefix = written(prefix.where("p.n > 0").select("window", "size", "words", "p.shingle", "p.offset"), "prefixes")

    base = written(_candidates(rows, _filter(prefix.select(size, "shingle").distinct(), most_bits)), "candidates")
    asked = base.select("id", "key", "n_words", F.explode("found").alias("f")).select("id", "key", "n_words", "f.*")
    placed = asked.join(prefix.withColumnRenamed("words", "wanted"), "shingle").withColumn("start", F.col("place") - F.col("offset"))
    inside = (F.col("start") >= F.col("first")) & (F.col("start") + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("words", " "), (F.col("start") - F.col("first") + 1).cast("int"), F.col("size")), " ") == F.col("wanted")
    hits = placed.where(inside).where(same).select("id", "key", "window", "start", (F.col("start") + F.col("size")).alias("end"))
    hits = written(hits.distinct(), "hits")

    named_items = hits.select("id", "key", "window").distinct().join(owners, "window").select("id", "key", "item").distinct()
    named_items = named_items.groupBy("id", "key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    verdicts = _spans(hits).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "n_hit", "ranges")
    same_row = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    verdicts = verdicts.join(named_items, same_row, "left").select("_id", "_key", "n_hit", "ranges", "items")
    verdicts = written(verdicts, "verdicts")
    discard(made, each, prefix, hits)
    out = base.select("id", "key", "n_words").join(verdicts, same_row, "left")
    none = F.expr("cast(array() as array<string>)")
    return out.select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.coalesce("ranges", F.expr("cast(array() as array<array<bigint>>)")).alias("ranges"),
    )


def _spans(hits: DataFrame) -> DataFrame:
    """id, key, n_hit, ranges: the hit places of a row as disjoint rising ranges, and how many words they have."""
    ordered = Window.partitionBy("id", "key").orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    places = hits.select("id", "key", "start", "end").distinct()
    marked = places.select("id", "key", "start", "end", F.coalesce(F.col("start") > before, F.lit(True)).cast("int").alias("new"))
    ranges = marked.withColumn("range", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranges.groupBy("id", "key", "range").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return ranges.groupBy("id", "key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.array("start", "end"))).alias("ranges"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """``contamination`` with the digest of the items and the verdict: hit words are a twentieth of all, or more."""
    found = contamination(docs, benchmark, **names)
    bad = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select("id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), bad.alias("contaminated"))


def items_digest(items: list[str]) -> str:
    """The digest that ``decontaminated`` gives for these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
