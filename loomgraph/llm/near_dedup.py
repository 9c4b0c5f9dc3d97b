"""Near-duplicates over word shingles: SuperMinHash signatures, banding, exact verification, grouped components.

SuperMinHash gives each element a random permutation of the signature's slots, made step by step: in step j the element
offers j plus a random part to its j-th slot. Once every slot has an offer from step j or before, later steps
cannot lower any, and the text is done. Long texts end after a step or two.

Five slots make a band; 60 bands make it a chance of 1e-7 that two sets of similarity 0.75 share none (less, the more they
share). What shares a band is only a candidate: links are confirmed on the full sets.

The same sets are one node. In each band's bucket every member is held against a pivot, in rounds, so that a group of copies
costs about as many comparisons as it has members. Their components tell which buckets still hold members of different
ones; these texts are joined by the rarest parts of their sets, without loss. Pairs within a component are never needed. Union of the links is by hooking and contraction over
tables; no task or driver holds a component.

Rows: a null or empty text, or one of white space, has no shingles and is alone; a text of fewer words than a shingle is one
shingle. Equal rows, also with equal ids, are copies of each other. Null ids are never a component's id. Texts of any length are compared whole. Of ties for a
bucket's pivot the least node number wins, which changes no result. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import GOLDEN, LOWER, mix, named
from loomgraph.plans.components import component_labels
from loomgraph.runtime import discard, written

SHINGLE, BANDS, ROWS = 5, 60, 5
SLOTS = BANDS * ROWS
PERCENT = 75
#: Pivot rounds end once all pairs of open members would be this many times their number at most, or a round closes less than this part of them.
FEW, LITTLE = 4, 0.1
#: Shingles whose permutations are held at once: 2 * SLOTS bytes each.
CHUNK = 40_000

_EMPTY = np.int64(np.iinfo(np.int64).max)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    import xxhash

    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, dtype="uint64")
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype="uint64")
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), dtype="uint64")
    for k in range(min(size, len(h))):
        out = mix(out * GOLDEN + h[k : k + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` numbers per set (none of them empty): step * 2**32 plus 32 random bits."""
    out = np.full((len(sets), slots), _EMPTY, dtype="int64")
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))  # sets that need as many steps go together
    at = 0
    while at < len(order):
        end, size = at + 1, len(sets[order[at]])
        while end < len(order) and size + len(sets[order[end]]) <= CHUNK:
            size += len(sets[order[end]])
            end += 1
        own = order[at:end]
        out[own] = _chunk([sets[k] for k in own], slots)
        at = end
    return out


def _chunk(sets: list[np.ndarray], slots: int) -> np.ndarray:
    flat = np.full(len(sets) * slots, _EMPTY, dtype="int64")
    table = flat.reshape(len(sets), slots)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seed = np.concatenate(sets)
    places: np.ndarray | None = None
    for step in range(slots):
        h = mix(seed + np.uint64((step + 1) * int(GOLDEN) & (1 << 64) - 1))
        pick = step + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step) >> np.uint64(32)).astype("int64")
        value = np.int64(step << 32) + (h >> np.uint64(32)).astype("int64")
        if places is None:
            slot = pick
        else:
            rows = np.arange(len(seed))
            slot = places[rows, pick].astype("int64")
        np.minimum.at(flat, owner * slots + slot, value)
        live = table.max(1) >= np.int64(step + 1) << 32
        if not live.any():
            break
        keep = live[owner]
        if places is None:
            kept = np.flatnonzero(keep)
            places = np.tile(np.arange(slots, dtype="uint16"), (len(kept), 1))
            rows = np.arange(len(kept))
            places[rows, pick[kept]] = 0  # the first swap, of slot 0 and the pick
        else:
            places[rows, pick] = places[rows, step]
            if not keep.all():
                places = places[keep]
        if not keep.all():
            owner, seed = owner[keep], seed[keep]
    return table


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket per band and signature; the band's number is part of the hash."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype("uint64")
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype="uint64"), (len(signature), BANDS)).copy()
    for k in range(ROWS):
        out = mix(out * GOLDEN + parts[:, :, k])
    return out.view("int64")


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for f in frames:
        sets = [shingles(t) for t in f["text"]]
        some = [k for k, s in enumerate(sets) if len(s)]
        found: list = [None] * len(sets)
        if some:
            for k, b in zip(some, bands(signatures([sets[k] for k in some])), strict=True):
                found[k] = b
        digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pd.DataFrame({"id": f["id"], "key": f["key"], "digest": digest, "n": [len(s) for s in sets], "bands": found})


def _shingled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"node": f["node"], "shingles": [shingles(t).view("int64") for t in f["text"]]})


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common, total of each pair, counted on the full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.select("a", "b", F.col("common").cast("long"), (F.col("na") + F.col("nb") - F.col("common")).cast("long").alias("total"))


def _linked() -> Column:
    return 100 * F.col("common") >= PERCENT * F.col("total")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id reachable), kept (that is the row's own id) per row.

    Shuffles texts once, for candidates; everything else that moves is ids and hashes. Grouped tables are written before they
    are joined, so that both sides of each join are plain and the engine may split a hot key.
    """
    rows = named(docs, id=id_col, text=text_col).select("id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    table = written(rows.mapInPandas(_signed, f"id {kind}, key binary, digest binary, n long, bands array<long>"), "signatures")

    grouped = table.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.min(F.struct("id", "key")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")

    member = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = written(member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = written(member.join(sizes, "bucket").select("bucket", "node", "size"), "shared")
    known = shared.groupBy("node").agg(F.sum(F.col("size") - 1).alias("met")).join(nodes.select("node", "n"), "node")
    members = written(shared.join(known, "node").select("bucket", "node", "met", "n"), "members")

    wanted = nodes.join(known.select("node"), "node", "left_semi").select("node", "row.id", F.col("row.key").alias("key"))
    texts = wanted.join(rows.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "text"), F.col("key").eqNullSafe(F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    sets = written(texts.select("node", "text").mapInPandas(_shingled, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    labels = _grouped(members, sets)
    discard(sizes, shared, members, sets)

    owned = nodes.join(labels.withColumnRenamed("id", "node"), "node", "left").select("digest", "least", F.coalesce("label", "node").alias("label"))
    first = written(owned.groupBy("label").agg(F.min("least").alias("component_id")), "first")
    found = owned.join(first, "label").select(F.col("digest").alias("_digest"), "component_id")
    out = table.join(found, (F.col("digest") == F.col("_digest")) & (F.col("n") > 0), "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their labels so far, of the buckets that hold more than one component."""
    of = labels.select(F.col("id").alias("node"), "label")
    placed = members.join(of, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    mixed = written(mixed, "mixed-buckets")
    out = written(placed.join(mixed, "bucket", "left_semi"), "mixed")
    discard(mixed)
    return out


def _sizes_fit(a: str, b: str) -> Column:
    return (100 * F.least(a, b)) >= PERCENT * F.greatest(a, b)


def _grouped(members: DataFrame, sets: DataFrame) -> DataFrame:
    """id, label of the linked nodes of ``members(bucket, node, met, n)``; met: how many others a node meets in its buckets.

    A round holds each bucket's members against one pivot, the one that meets most others: the text that copies were made
    from, as a rule, if it is there. Rounds end once one finds no link or closes few members, or few pairs are open; so their number has a bound. What is open
    then is joined exactly. Between rounds the links so far are one table, of each node with its component's least.
    """
    open_members = members.withColumn("label", F.col("node"))
    spent: DataFrame | None = None
    labels: DataFrame | None = None
    n_open: int | None = None
    while True:
        free = open_members if spent is None else open_members.join(spent, ["bucket", "node"], "left_anti")
        pivot = free.groupBy("bucket").agg(F.max(F.struct("met", F.negative("node").alias("least"), "node", "n", "label")).alias("p"))
        pivot = written(pivot.select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.label").alias("pl")), "pivots")
        asked = open_members.join(pivot, "bucket").where((F.col("label") != F.col("pl")) & _sizes_fit("n", "pn"))
        compared = _compared(asked.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), sets)
        found = written(compared.where(_linked()).select("a", "b"), "links")
        used = pivot.select("bucket", F.col("pivot").alias("node"))
        before, spent = spent, written(used if spent is None else spent.unionByName(used), "spent")
        discard(before, pivot)
        if found.isEmpty():
            discard(found)
            break
        before, labels = labels, _joined(labels, found)
        discard(before, found)
        before, open_members = open_members, _mixed(members, labels)
        discard(before)
        sizes = open_members.groupBy("bucket").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"), F.sum("c").alias("rows")).first()
        n_before, n_open = n_open, int(sizes.rows or 0)
        if not n_open or sizes.pairs <= FEW * n_open or (n_before is not None and n_open > (1 - LITTLE) * n_before):
            break
    nodes = written(open_members.select("node", "label", "n").distinct(), "open")
    pairs, prefixes = _prefix_pairs(nodes, sets)
    rest = written(_compared(pairs, sets).where(_linked()).select("a", "b"), "links")
    discard(nodes, open_members, spent, prefixes)
    if labels is None or not rest.isEmpty():
        before, labels = labels, _joined(labels, rest)
        discard(before)
    discard(rest)
    return labels


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """id, label of all nodes that were labelled or are linked."""
    links = links if labels is None else labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(links)
    return component_labels(links)


def _prefix_pairs(nodes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, and the written table that they are read from: pairs of ``nodes(node, label, n)`` with different labels that may be similar enough; none is missed.

    Each set's shingles are ordered from rare to common. Similar sets share one of the first n - 0.75 n + 1, so only these are joined, under
    the bounds that sizes and places put on what is shared. A passage that many texts have is common, so it comes last and
    pairs nobody.
    """
    held = sets.join(nodes, "node")
    counts = held.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("texts"))
    each = held.select("node", "label", "n", F.explode("shingles").alias("shingle")).join(counts, "shingle")
    ordered = each.groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("all"))
    prefix = F.expr(f"slice(all, 1, cast(n - ceil({PERCENT} * n / 100) + 1 as int))")
    first = ordered.select("node", "label", "n", F.posexplode(prefix).alias("place", "s")).where("s.texts > 1")
    first = written(first.select(F.col("s.shingle").alias("shingle"), "node", "label", "n", (F.col("n") - F.col("place")).alias("left")), "prefixes")
    one, two = (first.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "label", "n", "left")]) for k in "ab")
    enough = (100 + PERCENT) * F.least("left_a", "left_b") >= PERCENT * (F.col("n_a") + F.col("n_b"))
    pairs = one.join(two, "shingle").where((F.col("label_a") < F.col("label_b")) & _sizes_fit("n_a", "n_b") & enough)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), first
