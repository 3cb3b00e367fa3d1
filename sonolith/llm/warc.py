"""WARC archives: write records with payload deduplication and segmentation, read them back.

Writing: a payload is framed with chunked transfer coding behind an HTTP header and cut into
segments of bounded size; the first is the `response` record, the rest are `continuation`
records with the origin's id, a segment number and, in the last one, the total length.
A payload that another record already has becomes a `revisit` that names that record.
Reading: segments are grouped by origin id, ordered by number, checked against the total
length, and the chunked framing is decoded.

Archives are text files of Spark's own writer with CRLF CRLF between records, which is the
record separator of the format, so any store that Spark reaches can hold them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_dir, shuffles_dropped, small_batches

SEGMENT_BYTES = 16_384
RECORDS_PER_FILE = 1_024
CHUNK_BYTES = 4_096
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """Decode chunked transfer framing (extensions and trailers are skipped); ValueError if it is broken."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without an end")
        size = int(framed[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        part = framed[end + 2 : end + 2 + size]
        if len(part) != size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        parts.append(part)
        at = end + 4 + size


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, row: int = 0, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response and its continuations.

    A record id holds the page, the payload's digest and the number of the row; a revisit names
    the page and the digest that its response's id begins with.
    """
    found = digest(payload)
    own = f"<urn:page:{'none' if page_id is None else page_id}:{found}:{row}>"
    head = [("WARC-Record-ID", own), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{found}")]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *head, ("WARC-Refers-To", f"<urn:page:{refers_to}:{found}>")], b"")
        return
    block = _HTTP + chunked(payload)
    cuts = range(0, len(block), segment)
    for k, at in enumerate(cuts, 1):
        if k == 1:
            headers = [("WARC-Type", "response"), *head] + [("WARC-Segment-Number", 1)] * (len(cuts) > 1)
        else:
            headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k)]
            headers += [("WARC-Segment-Total-Length", len(block))] * (k == len(cuts))
        yield _record(headers, block[at : at + segment])


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write a record for each row of `pages` under `path`.

    Among records with equal payloads of at least `min_revisit_bytes`, the one with the
    largest id is a response and the others revisit it; smaller payloads are all responses.
    A null payload is empty, a null url is written as none. Ids are integers. Rows of equal id
    and payload get a record each, all of them responses if theirs is the largest id. A row
    without an id revisits a response that has one; without any, it is a response.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    many = rows.where(F.length("payload") >= min_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(many, "sha1", "left").select("page_id", "url", "payload", F.when((F.length("payload") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # only has to differ between the rows of one write

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            out = [r for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to", "row")), strict=True) for r in records_of(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value"))
    with shuffles_dropped(pages.sparkSession):
        records.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a whole archive."""
    at = 0
    while at < len(data):
        end = data.index(_END, at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines if ": " in x)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_segments(spark, path: str) -> DataFrame:
    """A row for each record: (origin, segment, total, record_type, digest, refers_to, block).

    A file holds at most RECORDS_PER_FILE records of SEGMENT_BYTES and their headers, which
    bounds the memory of a task.
    """
    schema = "origin string, segment int, total long, record_type string, digest string, refers_to string, block binary"
    names = ("origin", "segment", "total", "record_type", "digest", "refers_to", "block")
    types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["content"]:
                data = raw.as_buffer().to_pybytes()
                rows = []
                for h, block in parse_archive(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    total = h.get("WARC-Segment-Total-Length")
                    rows.append((h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), int(h.get("WARC-Segment-Number", 1)), int(total) if total else None if "WARC-Segment-Number" in h else len(block), h["WARC-Type"], h.get("WARC-Payload-Digest"), h.get("WARC-Refers-To"), block))
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], list(names))
                yield from small_batches([whole], 8 << 20)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, schema)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row for each original record: (origin, record_type, digest, refers_to, payload, payload_digest, intact).

    Segments are grouped by origin id and ordered by number; repeated segments count once.
    `intact` is false, and the payload null, if a number is missing, the total length differs
    or the chunked framing is broken. Revisits have no payload. A group is one record, so no
    group outgrows the payload it stands for.
    """
    grouped = segments.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max(F.when(F.col("record_type") != "continuation", F.struct("record_type", "digest", "refers_to"))).alias("first"),
    ).select("origin", "parts", "total", "first.*")
    schema = "origin string, record_type string, digest string, refers_to string, payload binary, payload_digest string, intact boolean"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 8 << 20):
            payloads: list[bytes | None] = []
            for parts, total, kind in zip(batch["parts"].to_pylist(), batch["total"].to_pylist(), batch["record_type"].to_pylist(), strict=True):
                by = {p["segment"]: p["block"] for p in parts}
                block = b"".join(by[k] for k in sorted(by))
                payload = None
                if kind == "response" and sorted(by) == list(range(1, len(by) + 1)) and len(block) == total:
                    head, gap, body = block.partition(_END)
                    try:
                        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body if gap else block
                    except ValueError:
                        payload = None
                payloads.append(payload)
            found = [None if p is None else digest(p) for p in payloads]
            intact = [k == "revisit" or p is not None for k, p in zip(batch["record_type"].to_pylist(), payloads, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("origin", "record_type", "digest", "refers_to")), pa.array(payloads, pa.binary()), pa.array(found, pa.string()), pa.array(intact)], ["origin", "record_type", "digest", "refers_to", "payload", "payload_digest", "intact"])

    return grouped.mapInArrow(join, schema)


def round_trip(pages: DataFrame, **more) -> DataFrame:
    """Write `pages` to archives in the shared folder, read them back, and give one row a page.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to, intact); a
    revisit has the length of the record that it names. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **more)
    number = lambda c: F.regexp_extract(c, r"page:(-?\d+):", 1).try_cast("long")
    read = reassemble(read_segments(spark, path)).select(
        number("origin").alias("page_id"), F.length("payload").cast("long").alias("own_bytes"), "record_type", "intact",
        F.coalesce("payload_digest", F.substring_index("digest", ":", -1)).alias("payload_digest"), F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"),
    )
    read = materialise(read, "warc-rows")
    # slim rows; a digest that very many revisits share makes a large partition that adaptive execution splits
    sizes = read.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("own_bytes").alias("known_bytes"))
    return read.join(sizes, "payload_digest").select("page_id", F.coalesce("own_bytes", "known_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "intact")
