"""WARC archives: written with long payloads in segments and deduplicated payloads as revisits, read back by reassembly."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch, small, stage, tidy

SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
REVISIT_BYTES = 1000
RECORDS_A_FILE = 2048
BATCH_CHARS = 4 << 20
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

RECORD = "origin string, segment int, total bigint, page_id bigint, record_type string, target string, digest string, status string, payload_bytes bigint, block binary"


def _cut(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about a size, cut between characters, so that an archive of text stays valid UTF-8."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[start:end]
        start = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cut(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """Decodes chunked transfer framing; None if it is broken or cut short."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return None
        n = int(size, 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, record_id: str, block: bytes, **fields: object) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *((k.replace("_", "-"), v) for k, v in fields.items() if v is not None), ("Content-Length", len(block))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block.decode("utf-8")


def records(page: tuple, segment_bytes: int) -> Iterator[str]:
    """The WARC records of a page, each without the four bytes that end it: a response, in segments if it is long, or a revisit."""
    page_id, url, payload, digest, ordinal, refers = page
    uri = re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "unknown:")
    own = f"urn:page:{ordinal}"
    fields = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}", "X_Page_ID": page_id, "Content_Type": "application/http; msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers is not None:
        yield _record("revisit", own, head, WARC_Refers_To=f"<urn:page:{refers}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **fields)
        return
    block = head + chunked(payload)
    parts = list(_cut(block, segment_bytes))
    if len(parts) == 1:
        yield _record("response", own, block, **fields)
        return
    yield _record("response", own, parts[0], WARC_Segment_Number=1, **fields)
    for k, part in enumerate(parts[1:], 2):
        yield _record("continuation", f"{own}:{k}", part, WARC_Segment_Number=k, WARC_Segment_Origin_ID=f"<{own}>", WARC_Segment_Total_Length=len(block) if k == len(parts) else None)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES, records_a_file: int = RECORDS_A_FILE) -> None:
    """Writes gzipped WARC files below a path, by Spark's own writer, so that any store Spark knows will do.

    Among equal payloads of at least revisit_bytes, the row with the largest id is the response (of equal ids, one row), the
    others revisit it. Rows get their numbers once and are written with them, so that a task that runs again, or a table that
    comes in another order, changes none. Only the few bytes of digest and id are grouped; payloads move only where the table
    of digests that recur is too large to send to every task. Null payloads are empty, null URLs are `unknown:`."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("ordinal"))
    rows = stage(rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))), "pages")
    numbered = rows
    rows = rows.withColumn("again", F.when(F.octet_length("html") >= revisit_bytes, F.col("digest")))
    first = rows.where(F.col("again").isNotNull()).groupBy("again").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "ordinal")).alias("last")).where("n > 1")
    first = small(stage(first.select("again", F.col("last.ordinal").alias("last")), "recurring"))
    marked = rows.withColumn("again", F.coalesce("again", F.concat(F.lit("-"), "digest"))).join(first, "again", "left")
    marked = marked.withColumn("refers", F.when(F.col("last") != F.col("ordinal"), F.col("last")))
    marked = marked.select("page_id", "url", F.when(F.col("refers").isNull(), F.col("html")).alias("html"), "digest", "ordinal", "refers")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines: list[str] = []
            size = 0
            for page, url, html, digest, ordinal, refers in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                lines += records((page, url, (html or "").encode(), digest, ordinal, refers), segment_bytes)
                size += len(html or "")
                if size > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                    lines, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    marked.mapInArrow(tidy(render), "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)
    discard(numbered)


def _unzip(data: bytes) -> bytes:
    """All members of a gzip file; other data as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out) + data


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, with lower-cased names, and block of each record, by Content-Length."""
    at = 0
    while (at := archive.find(b"WARC/1.", at)) >= 0:
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(head["content-length"])
        yield head, archive[start:at]


def _payload(block: bytes, digest: str) -> tuple[str, int | None, str]:
    """Status, payload length and SHA-1 of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if payload is None:
        return "broken chunks", None, digest
    found = hashlib.sha1(payload).hexdigest()
    return "ok" if found == digest else "other digest", len(payload), found


def _rows(archive: bytes) -> Iterator[tuple]:
    for head, block in parse(archive):
        kind = head["warc-type"]
        own = head["warc-record-id"].strip("<>")
        page = int(head["x-page-id"]) if head.get("x-page-id", "None") != "None" else None
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        segment = int(head.get("warc-segment-number", 0))
        if kind == "revisit":
            yield own, 0, None, page, kind, head["warc-refers-to"].strip("<>"), digest, "ok", None, None
        elif segment == 0:
            status, n, digest = _payload(block, digest)
            yield own, 0, None, page, kind, None, digest, status, n, None
        else:
            total = int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None
            yield head.get("warc-segment-origin-id", own).strip("<>"), segment, total, page, kind if segment == 1 else None, None, digest or None, None, None, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, status: one row a record that isn't a continuation.

    Whole records are decoded where they are read. Segments are grouped by the identifier of their origin, ordered by their
    number, their lengths checked against the total that the last one states, and the chunked framing decoded. A group holds
    one payload. Revisits get the length from the response they refer to. status: ok; missing segment, other length, broken
    chunks or other digest (length then null); no response (a revisit of a record that isn't there)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows = list(_rows(_unzip(content)))
                for k in range(0, len(rows), 512):
                    part = pd.DataFrame(rows[k : k + 512], columns=names)
                    yield part.astype({c: "Int64" for c in ("segment", "total", "page_id", "payload_bytes")})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for origin, page, kind, target, digest, status, n, parts in batch.itertuples(index=False):
                if parts is not None and len(parts):
                    total = parts[-1]["total"]
                    block = b"".join(x["block"] for x in parts)
                    if total is None or pd.isna(total) or [x["segment"] for x in parts] != list(range(1, len(parts) + 1)):
                        status = "missing segment"
                    elif len(block) != total:
                        status = "other length"
                    else:
                        status, n, digest = _payload(block, digest)
                out.append((origin, page, kind, target, digest, status, n))
            done = pd.DataFrame(out, columns=["origin", "page_id", "record_type", "target", "digest", "status", "payload_bytes"])
            yield done.astype({"page_id": "Int64", "payload_bytes": "Int64"})

    parts = F.array_sort(F.collect_list(F.when(F.col("segment") > 0, F.struct("segment", "total", "block"))))
    grouped = files.mapInPandas(scan, RECORD).groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("record_type").alias("record_type"), F.max("target").alias("target"), F.max("digest").alias("digest"), F.max("status").alias("status"), F.max("payload_bytes").alias("payload_bytes"), parts.alias("parts"))
    found = stage(grouped.mapInPandas(join, "origin string, page_id bigint, record_type string, target string, digest string, status string, payload_bytes bigint"), "records")
    responses = found.where("record_type = 'response'").select(F.col("origin").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"))
    own = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type"]
    revisits = found.where("record_type = 'revisit'").join(responses, "target", "left")
    again = revisits.select("page_id", F.col("n").alias("payload_bytes"), own[2], "record_type", "refers_to", F.when(F.col("n").isNull(), "no response").otherwise(F.col("status")).alias("status"))
    return found.where("record_type <> 'revisit' or record_type is null").select(*own, F.lit(None).cast("long").alias("refers_to"), "status").unionByName(again)


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes the archives of a table into the shared folder and reads them back. Repeated rows are records of their own; an empty table gives none."""
    path = f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, segment_bytes=segment_bytes)
    return read(pages.sparkSession, path)
