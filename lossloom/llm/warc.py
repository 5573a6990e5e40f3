"""WARC archives: writing with segmented and chunked records, and reading back by segment reassembly.

Records are framed in the tasks and written by Spark's text writer, whose line separator is the end of a WARC record;
archives are gzip files in any store that Spark can write. Reading takes archives through the binary file source. Records cut into
segments are grouped by the identifier of their origin, ordered by segment number, checked against the total length and
only then decoded. A page's segments may lie in different archives.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lossloom.llm.common import HOT
from lossloom.sources.store import cut_lineage, shared_root

CRLF = b"\r\n"
END = b"\r\n\r\n"
SEGMENT = 16 * 1024
CHUNK = 4 * 1024
#: Payloads from this size on are revisited instead of written again.
LEAST_REVISIT = 100
RECORDS_PER_FILE = 1000
DATE = "2024-01-01T00:00:00Z"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(body[i:i + size]), body[i:i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """Body of a chunked message; extensions and trailers are passed over, a broken frame raises ValueError."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size line missing")
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size:at + size + 2] != CRLF:
            raise ValueError("chunk shorter than stated")
        out.append(data[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, body) of an HTTP response block, transfer framing undone and the stated length checked."""
    head, sep, body = block.partition(END)
    if not sep:
        raise ValueError("HTTP header not ended")
    headers = _headers(head.split(CRLF)[1:])
    if headers.get("transfer-encoding", "").lower() == "chunked":
        return headers, dechunked(body)
    if "content-length" in headers and body and int(headers["content-length"]) != len(body):
        raise ValueError("HTTP body length differs from its header")
    return headers, body


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines if line)
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [b"WARC/1.1", *[f"{k}: {v}".encode() for k, v in fields], b"Content-Length: %d" % len(block)]
    return CRLF.join(head) + END + block


def records(key, url, payload: bytes, digest: str, first, uid: int, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, without their closing blank lines. ``first``: the page that holds the same payload, or None."""
    name = uuid.UUID(hashlib.md5(f"{key}|{url}|{digest}|{uid}".encode()).hexdigest())
    ident = f"<urn:uuid:{name}>"
    common = [("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    common += [("X-Page-Id", str(key))] if key is not None else []
    plain = name.int % 2 == 0
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d" % len(payload) if plain or first is not None else b"Transfer-Encoding: chunked"
    if first is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", ident), *common, ("X-Refers-To-Page", str(first)),
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], http + END)
        return
    block = http + END + (payload if plain else chunked(payload))
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", ident), *common], block)
        return
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", ident), *common, ("WARC-Segment-Number", "1")], parts[0])
    for i, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(name, str(i))}>"),
                       ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", str(i)), *common[:2], *more], part)


def write(pages: DataFrame, path: str, id_col: str = "page_id", segment: int = SEGMENT) -> None:
    """Archive one page per row under ``path``; null html is an empty payload, a null url becomes about:blank.

    Equal payloads (by SHA-256) of at least LEAST_REVISIT bytes: rows with the smallest id are responses, the others revisit it.
    Rows without an id revisit when another row has one, else they are responses. Segments are dealt over the archives.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    uid = F.monotonically_increasing_id()  # of the scan, so that a repeated task gives the same value
    rows = pages.select(F.col(id_col).alias("_id"), F.col("url").cast("string").alias("_url"), payload.alias("_payload"),
                        F.sha2(payload, 256).alias("_digest"), uid.alias("_uid"))
    long_ = F.length("_payload") >= LEAST_REVISIT
    groups = cut_lineage(rows.where(long_).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size")), "warc-digests")
    repeated = groups.where(F.col("_size") > 1)
    known = _with_first(rows, repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for key, url, body, digest, u, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for r in records(key, url, body, digest, first if first != key else None, u, segment):
                    out.append(r)
                    size += len(r)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    known.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option(
        "compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _with_first(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows with the first page of their payload, null where the payload is short or stands alone. Hot payloads are broadcast."""
    total = repeated.agg(F.sum("_size")).first()[0] or 0
    hot = repeated.where(F.col("_size") * HOT > total).select("_digest", F.col("_first").alias("_hot"), F.lit(True).alias("_is_hot"))
    cold = repeated.where(F.col("_size") * HOT <= total).select("_digest", "_first")
    marked = rows.join(F.broadcast(hot), "_digest", "left")
    warm = marked.where(F.col("_is_hot").isNull())
    done = marked.where("_is_hot").withColumn("_first", F.col("_hot"))
    both = done.unionByName(warm.join(cold, "_digest", "left")) if not cold.isEmpty() else marked.withColumn("_first", F.col("_hot"))
    return both.select("_id", "_url", "_payload", "_digest", "_uid", "_first")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive, gzip members included; a broken frame raises ValueError."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data:
            d = zlib.decompressobj(31)
            out.append(d.decompress(data) + d.flush())
            data = d.unused_data
        data = b"".join(out)
    at = 0
    while at < len(data):
        end = data.find(END, at)
        lines = data[at:end].split(CRLF)
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = _headers(lines[1:])
        size = int(headers["content-length"])
        at = end + 4 + size
        if data[at:at + 4] != END:
            raise ValueError("record shorter than stated")
        yield headers, data[end + 4:at]
        at += 4


PARTS = T.StructType([T.StructField("origin", T.StringType()), T.StructField("segment", T.LongType()), T.StructField("total", T.LongType()),
                      T.StructField("record_type", T.StringType()), T.StructField("page", T.StringType()), T.StructField("refers", T.StringType()),
                      T.StructField("digest", T.StringType()), T.StructField("block", T.BinaryType()), T.StructField("bytes", T.LongType())])


def _part(headers: dict[str, str], block: bytes) -> tuple:
    """A parsed record; whole responses are decoded at once, segments keep their block until they are joined."""
    kind = headers["warc-type"]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    number = int(headers.get("warc-segment-number", "0"))
    total = int(headers["warc-segment-total-length"]) if "warc-segment-total-length" in headers else None
    origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page")
    if number:
        return origin, number, total, kind, page, refers, digest, block, None
    http, body = payload_of(block)
    if kind == "revisit":
        return origin, 0, None, kind, page, refers, digest, None, int(http["content-length"])
    return origin, 0, None, kind, page, refers, hashlib.sha256(body).hexdigest(), None, len(body)


def reassembled(parts: list[tuple]) -> tuple:
    """One record from its segments in order; missing, repeated or short segments raise ValueError."""
    block = b"".join(p[7] for p in parts)
    if [p[1] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1][2] != len(block):
        raise ValueError(f"segments of {parts[0][0]} are incomplete")
    _, body = payload_of(block)
    return (*parts[0][:1], 0, None, *parts[0][3:6], hashlib.sha256(body).hexdigest(), None, len(body))


def read(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type (response or revisit), refers_to.

    Sizes and digests of responses are computed from the decoded payload; a revisit states those of the payload it refers to.
    """
    id_type = id_type or T.LongType()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in PARTS]
        for batch in batches:
            for content in batch.column(0):
                rows = [_part(h, b) for h, b in parse(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else
                                                 [pa.array([], t) for t in types], PARTS.names)

    out = T.StructType([T.StructField("page", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
                        T.StructField("record_type", T.StringType()), T.StructField("refers", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(cols[i], to_arrow_type(f.dataType)) for i, f in zip((4, 8, 6, 3, 5), out, strict=True)], out.names)

        for batch in batches:
            done = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][0] != row[0]:
                    done.append(reassembled(held))
                    held = []
                if row[1]:
                    held.append(row)
                else:
                    done.append(row)
            yield emit(done)
        if held:
            yield emit([reassembled(held)])

    parts = files.mapInArrow(split, PARTS).repartition("origin").sortWithinPartitions("origin", "segment")
    return parts.mapInArrow(join, out).select(
        F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"))


def archive_and_read(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write all pages to a fresh folder under the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = f"{shared_root(spark)}/lossloom/{spark.sparkContext.applicationId}/warc/{uuid.uuid4().hex[:12]}"
    write(pages, path, id_col)
    return read(spark, path, pages.schema[id_col].dataType)
