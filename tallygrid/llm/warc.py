"""WARC archives with revisit resolution.

Headers alone (id, digest, length; no payload) are shuffled by payload digest to find each group's original response and the
records that revisit it. Only these join the pages again, by id, and stay where the pages are read as long as they are
few enough to be broadcast; beyond, pages are dealt by id, never by digest. Archives are written with fresh headers: originals carry
their payload, the others become revisit records that name the original and its digest. Archives are gzip members, one
a record, in segments of bounded size; a segment is a row of a table in the shared folder, as only Spark's writers reach
every store, and concatenated segments of one archive are a valid .warc.gz file.

Reading takes the archives alone: response payloads are measured and digested anew, revisit records are resolved by a
join to the response they refer to; one without its response, or with another digest, fails the job.

Defined cases: null payload counts as empty; payloads below the limit are always responses; of equal payloads the
largest id is the response, and repeated rows of that id are all responses, with record ids of their own; a null id is
smaller than any other and refers to a response like others, records of null ids alone are all responses; null url
leaves the target header out; very long payloads are one record of one segment; an empty table gives empty archives;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T
from .staging import GROUP_BYTES, small, small_batches, stage

#: Payloads of fewer bytes are not worth a revisit record.
LEAST = 1000
SEGMENT_BYTES = 2 << 20
_ID = "<urn:page:{}{}>"
_DATE = "1970-01-01T00:00:00Z"  # no capture time is known; a fixed one keeps archives reproducible


def payloads(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest (SHA-1)."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return small_batches(pages).select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))


def originals(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """digest and length -> the id of the response, for payloads that occur more than once. Partial sums before the
    shuffle: a payload that a third of all pages share sends one row a task."""
    g = headers.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    return g.agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def marks(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_digest, refers_to, repeated) of the records that revisit another or whose id is repeated. Written."""
    found = headers.join(small(stage(originals(headers, least), light=True), 80), ["payload_digest", "payload_bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    often = headers.groupBy("page_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(F.col("page_id").alias("often"), F.lit(True).alias("repeated"))
    found = found.select("page_id", "payload_digest", refers.alias("refers_to"))
    found = found.join(small(stage(often, light=True), 16), found["page_id"].eqNullSafe(F.col("often")), "left")
    return stage(found.filter("refers_to is not null or repeated").select("page_id", "payload_digest", "refers_to", F.coalesce("repeated", F.lit(False)).alias("repeated")).distinct(), light=True)


def record(page_id, url: str | None, digest: str, payload: bytes | None, refers_to=None, copy: str = "") -> bytes:
    """One WARC/1.1 record; without a payload it is a revisit. `copy` sets records of one page id apart."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {_ID.format(page_id, copy)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        lines += [f"WARC-Refers-To: {_ID.format(refers_to, '')}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        lines.append("Content-Type: text/html")
    body = payload or b""
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archive, part = TaskContext.get().partitionId(), 0
    held: list[bytes] = []
    size = 0

    def segment() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive], pa.int32()), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["archive", "segment", "content"])

    for b in batches:
        ids, urls, digests, refers, repeated = (b.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
        for k, (i, u, d, r, often) in enumerate(zip(ids, urls, digests, refers, repeated, strict=True)):
            m = _member(record(i, u, d, None if r is not None else b.column(2)[k].as_py(), r, f":{archive}.{part}.{len(held)}" if often else ""))
            if held and size + len(m) > SEGMENT_BYTES:
                yield segment()
                part, held, size = part + 1, [], 0
            held.append(m)
            size += len(m)
    if held:
        yield segment()


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """The archives of all pages: (archive, segment, content), written to the shared folder."""
    records = payloads(pages, page_id, url, html)
    side = small(marks(stage(records.select("page_id", "payload_digest", "payload_bytes")), least), 80)
    side = side.withColumnsRenamed({"page_id": "_page_id", "payload_digest": "_digest"})
    found = records.join(side, records["page_id"].eqNullSafe(F.col("_page_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return stage(found.select("page_id", "url", "payload", "payload_digest", "refers_to", F.coalesce("repeated", F.lit(False)).alias("repeated")).mapInArrow(T.tidy(_write), "archive int, segment int, content binary"), "none", group_bytes=GROUP_BYTES)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a segment."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts, some = zlib.decompressobj(31), [], 1 << 10
        while not z.eof:  # in growing slices, so that what follows a small record is not copied with it
            if at >= len(view):
                raise ValueError("a record is cut off")
            piece = view[at : at + some]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
            some *= 2
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def _number(urn: str) -> int | None:
    x = urn[len("<urn:page:") : -1].split(":")[0]
    return None if x == "None" else int(x)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            rows = []
            for h, body in parse(content.as_py()):
                full = h["WARC-Type"] == "response"
                digest = hashlib.sha1(body).hexdigest() if full else h["WARC-Payload-Digest"].removeprefix("sha1:")
                if full and h["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError(f"{h['WARC-Record-ID']}: payload and digest differ")
                rows.append((_number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], digest, len(body) if full else None, None if full else _number(h["WARC-Refers-To"])))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"])


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record: page_id, url, record_type, payload_digest, payload_bytes, refers_to."""
    rows = stage(archives.select("content").mapInArrow(_read, "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint"))
    full = rows.filter("record_type = 'response'")
    revisits = rows.filter("record_type = 'revisit'").drop("payload_bytes")
    # only originals that something refers to take part; many revisits of one original are a skew that Spark splits
    known = small(stage(revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct(), light=True), 80)
    lengths = full.join(known, ["page_id", "payload_digest"], "left_semi").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("full_bytes"))
    resolved = revisits.join(small(stage(lengths, light=True), 80), ["refers_to", "payload_digest"], "left")
    size = F.when(F.col("full_bytes").isNotNull(), F.col("full_bytes")).otherwise(F.raise_error(F.concat(F.lit("no response with its digest for the revisit record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("bigint"))
    columns = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"]
    return full.select(columns).unionByName(resolved.withColumn("payload_bytes", size).select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS m FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND m IS NOT NULL AND m IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND m IS DISTINCT FROM page_id THEN m END AS refers_to
FROM o
"""
