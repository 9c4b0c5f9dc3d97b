"""WARC archives of pages: written with chunked framing, segments and revisits, and read back whole.

A record whose block is longer than SEGMENT is written as its first part and continuation records. Reading groups
the parts by the identifier of the first, orders them by segment number, checks their total length and the payload's digest, and
decodes the chunked framing. Records in one part skip the grouping.

Payloads of REVISIT_BYTES or more that are equal are stored once: the row with the least page id is the response, the others refer to it by its identifier.

Archives of other writers are read too: plain or gzipped, with responses and revisits of any identifiers; other kinds of records are passed over. A payload is checked against its
digest if that is by an algorithm that is known here. Page ids come from a field of their own, which other writers' records lack: these have null.

Rows: a null html is an empty payload; a null url is written as an empty target. Repeated rows are records of their own with equal identifiers, and each
comes back. A page without an id is written without one and comes back with null. Payloads of any length are written and read whole. Of equal payloads with equal least ids, each is a
response. An empty table gives an empty archive. Only the three named columns are read, so others may have any names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import named
from loomgraph.runtime import written

SEGMENT = 32 * 1024
CHUNK = 8 * 1024
#: Payloads up to this are sent with a length, longer ones chunked.
PLAIN = 4 * 1024
REVISIT_BYTES = 100
RECORDS_PER_FILE = 2_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: The field of a page's id in archives that are written here.
PAGE = "Loomgraph-Page-ID"
#: Digests that can be checked, by the names that archives give them.
ALGORITHMS = {"sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha512": hashlib.sha512, "sha-512": hashlib.sha512, "md5": hashlib.md5}


def record_id(page: object, digest: str) -> str:
    return f"<urn:page:{'' if page is None or page != page else int(page)}:{digest}>"


def differs(payload: bytes, digest: str) -> str | None:
    """What a payload's digest is, if a field ``algorithm:value``, in hex or base 32, says something else; None too if the algorithm is unknown."""
    name, _, value = digest.partition(":")
    if not value or (make := ALGORITHMS.get(name.lower())) is None:
        return None
    raw = make(payload).digest()
    told = value.strip().lower()
    return None if told in (raw.hex(), base64.b32encode(raw).decode().lower(), base64.b32encode(raw).decode().rstrip("=").lower()) else raw.hex()


def framed(payload: bytes) -> bytes:
    """An HTTP message."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if len(payload) <= PLAIN:
        return head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    parts = [head + b"Transfer-Encoding: chunked\r\n\r\n"]
    for k in range(0, len(payload), CHUNK):
        part = payload[k : k + CHUNK]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(message: bytes) -> bytes:
    """The payload of an HTTP message, by its length or out of its chunks; trailers and chunk extensions are passed over."""
    head, _, body = message.partition(END)
    fields = dict(_fields(head.split(b"\r\n")[1:]))
    if b"chunked" not in fields.get("transfer-encoding", b"").lower():
        size = int(fields.get("content-length", len(body)))
        if size > len(body):
            raise ValueError("the body is shorter than its length field says")
        return body[:size]
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def _fields(lines: list[bytes]) -> Iterator[tuple[str, bytes]]:
    for line in lines:
        name, _, value = line.partition(b":")
        yield name.decode("latin-1").strip().lower(), value.strip()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """Without the two line ends that follow a record; the text writer puts them there."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(page: object, url: str | None, payload: bytes, digest: str, first: object) -> Iterator[bytes]:
    """The records of one page; ``first`` is the page that it refers to, or its own id."""
    own = record_id(page, digest)
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", (url or "").replace("\r", "").replace("\n", "")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    common += [] if page is None else [(PAGE, int(page))]
    if record_id(first, digest) != own:
        head = framed(payload).partition(END)[0] + END
        yield _record([("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest)), *common], head)
        return
    block = framed(payload)
    if len(block) <= SEGMENT:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    for k, at in enumerate(range(0, len(block), SEGMENT), 1):
        part = block[at : at + SEGMENT]
        if k == 1:
            yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], part)
            continue
        last = [("WARC-Segment-Total-Length", len(block))] if at + SEGMENT >= len(block) else []
        name = f"{own[:-1]}:{k}>"
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), *last], part)


def _written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out: list[bytes] = []
        size = 0
        for page, url, html, digest, first in zip(f["page"].astype(object), f["url"], f["html"], f["digest"], f["first"].astype(object), strict=True):
            page, first = (None if pd.isna(x) else x for x in (page, first))
            for r in records(page, url, (html or "").encode(), digest, first):
                out.append(r)
                size += len(r)
            if size > 16 << 20:
                yield pd.DataFrame({"value": out})
                out, size = [], 0
        yield pd.DataFrame({"value": out})


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Uncompressed .warc text files below ``path``, in any store that Spark writes to. A task's files appear when it commits."""
    rows = named(pages, page=id_col, url=url_col, html=html_col)
    rows = rows.select(F.col("page").cast("long").alias("page"), "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= REVISIT_BYTES
    equal = rows.where(large).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    equal = written(equal, "equal")  # a small table as a rule: its size decides how it is joined
    rows = rows.join(equal, "digest", "left").withColumn("first", F.coalesce("first", "page"))
    made = rows.select("page", "url", "html", "digest", "first").mapInPandas(_written, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """Fields and block of the records of a file, one after another by their lengths."""
    at = 0
    while True:
        while content[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(content):
            return
        end = content.index(END, at)
        lines = content[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(_fields(lines[1:]))
        size = int(fields["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = end + 4 + size


_RECORD = "page_id long, url string, record string, record_type string, refers string, payload_bytes long, payload_digest string, payload binary"
_PART = ", origin string, number int, total long, block binary"
_NAMES = [x.split()[0] for x in (_RECORD + _PART).split(", ")]


def _whole(page: int | None, record: str, url: str | None, digest: str, message: bytes, http: bool, keep: bool) -> tuple:
    payload = unframed(message) if http else message
    if found := differs(payload, digest):
        raise ValueError(f"{record}: the payload has digest {found}")
    return (page, url, record, "response", None, len(payload), hashlib.sha256(payload).hexdigest(), payload if keep else None)


def _is_http(fields: dict[str, str], block: bytes) -> bool:
    return fields.get("content-type", "application/http").lower().startswith("application/http") and block[:5] == b"HTTP/"


def _read(keep: bool):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                out, size = [], 0
                content = bytes(content)
                for fields, block in parse(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    text = {k: v.decode("utf-8", "replace") for k, v in fields.items()}
                    record, url, kind = text.get("warc-record-id", ""), text.get("warc-target-uri"), text.get("warc-type", "").lower()
                    digest, page = text.get("warc-payload-digest", ""), text.get(PAGE.lower())
                    page = int(page) if page else None
                    if kind == "revisit":
                        told = digest.partition(":")[2].lower() if digest.lower().startswith(("sha256:", "sha-256:")) else None
                        out.append((page, url, record, "revisit", text.get("warc-refers-to"), None, told, None, None, None, None, None))
                    elif kind == "continuation" or (kind == "response" and "warc-segment-number" in text):
                        total = text.get("warc-segment-total-length")
                        origin = text.get("warc-segment-origin-id", record)
                        out.append((page, url, record, None, None, None, digest, None, origin, int(text["warc-segment-number"]), int(total) if total else None, block))
                        size += len(block)
                    elif kind == "response":
                        out.append(_whole(page, record, url, digest, block, _is_http(text, block), keep) + (None,) * 4)
                        size += len(block) * keep
                    if size > 16 << 20:
                        yield _frame(out, _NAMES)
                        out, size = [], 0
                yield _frame(out, _NAMES)

    return rows


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("page_id", "payload_bytes", "number", "total"):
        if c in out:
            out[c] = out[c].astype("Int64")
    return out


def _reassembled(keep: bool):
    """The record of one origin's parts, each of which is there once, and how often the first one was."""

    def rows(f: pd.DataFrame) -> pd.DataFrame:
        parts = f.sort_values("number")
        message = b"".join(parts["block"])
        total = parts["total"].dropna()
        if list(parts["number"]) != list(range(1, len(parts) + 1)) or not len(total) or int(total.iloc[0]) != len(message):
            raise ValueError(f"{f['origin'].iloc[0]}: segments are missing")
        first = parts.iloc[0]
        page = None if pd.isna(first["page_id"]) else int(first["page_id"])
        row = _whole(page, first["record"], first["url"], first["digest"], message, message[:5] == b"HTTP/", keep)
        return _frame([row], _NAMES[:8]).assign(copies=int(first["copies"]))

    return rows


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, record, record_type, refers_to (the page of the record that a revisit refers to), payload_bytes, payload_digest (SHA-256 in hex) and, with
    ``payloads``, payload per response or revisit.

    Files are read by Spark, one task each as a rule; a file that is written here has RECORDS_PER_FILE records at most. Equal parts of equal records are brought to one before they are
    grouped, so a group is one record, however often it is there. A revisit gets its size, digest and payload from the
    response that it refers to, by a join that the engine may split where one response has many revisits; they are null if that is not in the archive.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    table = written(files.mapInPandas(_read(payloads), _RECORD + _PART), "records")
    names = _NAMES[:8]
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("page_id", "url", "record")]
    parts = table.where("origin IS NOT NULL").groupBy("origin", "number").agg(*first, F.first("payload_digest").alias("digest"), F.max("total").alias("total"), F.first("block").alias("block"), F.count("*").alias("copies"))
    whole = parts.groupBy("origin").applyInPandas(_reassembled(payloads), f"{_RECORD}, copies long")
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)
    found = table.where("origin IS NULL").select(*names).unionByName(whole)
    responses, revisits = found.where("record_type = 'response'"), found.where("record_type = 'revisit'")
    asked = revisits.select("refers").distinct()
    known = responses.select(F.col("record").alias("refers"), "page_id", "payload_bytes", "payload_digest", "payload").join(asked, "refers", "left_semi")
    known = known.groupBy("refers").agg(F.first("page_id").alias("refers_to"), *[F.first(c).alias(f"known_{c}") for c in ("payload_bytes", "payload_digest", "payload")])
    known = written(known, "referred")  # a plain table: the engine may split the revisits of one response
    back = revisits.drop("payload_bytes", "payload").join(known, "refers", "left")
    back = back.select("page_id", "url", "record", "record_type", "refers_to", F.col("known_payload_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "known_payload_digest").alias("payload_digest"), F.col("known_payload").alias("payload"))
    out = responses.withColumn("refers_to", F.lit(None).cast("long")).select(*back.columns).unionByName(back)
    return out if payloads else out.drop("payload")
