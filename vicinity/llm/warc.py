"""Operator 4, WARC: segmented archives, written by Spark and put together again.

Writing: each page becomes a ``response`` record (an HTTP message with a chunked body), or, if an
equal payload belongs to a smaller id, a ``revisit`` record without body.  A block longer than the
segment size is split into a first record and ``continuation`` records.  Spark's text sink writes
the records as gzip archives of a bounded number of records each, with the end of record as the
line separator.

Reading: every archive is parsed by the lengths that its records state, so payload bytes can never
be taken for a record's start.  Records of one piece are decoded on the spot; segments are grouped
by origin, put in order by their number, checked against the stated total length and decoded.  The
group holds one page, never more.

Equal payloads are found on (id, digest) pairs only.  A payload may belong to a third of all pages,
so the smallest id of each digest is found with partial sums, and digests shared by more than a
thousandth of the pages (there are at most a thousand) reach the pages by broadcast.

Rules for odd input: a null payload is empty, and payloads under the least size are always
responses; a null url is written as an empty one; every row has its own record, so rows that repeat
an id come back as often (of equal payloads under one id, each is the response); a null id comes
back as null and refers to nothing; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm.common import cut_lineage, scratch_path, ship_by_value

END = "\r\n\r\n"
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT_BYTES = 100
#: Records of one archive; with the segment size, this bounds what a reading task holds.
RECORDS_PER_FILE = 1_000
_PREFIX = "urn:page:"

_RECORD = "origin string, page string, segment long, total long, kind string, digest string, refers string, n_bytes long, block binary"


def _chunked(body: bytes, size: int) -> bytes:
    parts = []
    for at in range(0, len(body), size):
        piece = body[at:at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """Payload of a chunked body; raises on broken framing."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            if body[at:at + 2] != b"\r\n":
                raise ValueError("chunked body without its end")
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length than stated")
        parts.append(body[at:at + size])
        at += size + 2


def _headers(pairs: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def _uri(page: str | None, row: str | None = None) -> str:
    """Names a page or, with ``row``, one of its rows; a null page has an empty name."""
    return _PREFIX + quote(page or "", safe="") + (f";{row}" if row else "")


def _records(page: str | None, row: str, url: str, body: bytes, digest: str, refers: str | None, segment: int, chunk: int) -> Iterator[bytes]:
    url, own = "".join(url.split()), _uri(page, row)
    common = [("WARC-Record-ID", f"<{own}>"), ("WARC-Target-URI", url), ("WARC-Date", "2024-01-01T00:00:00Z"),
              ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        yield _headers([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", f"<{_uri(refers)}>"),
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(body, chunk)
    pieces = [block[at:at + segment] for at in range(0, len(block), segment)]
    for number, piece in enumerate(pieces, 1):
        if number == 1:
            pairs = [("WARC-Type", "response"), *common, ("Content-Type", "application/http; msgtype=response")]
            if len(pieces) > 1:
                pairs.append(("WARC-Segment-Number", 1))
        else:
            pairs = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{own};{number}>"), ("WARC-Date", "2024-01-01T00:00:00Z"),
                     ("WARC-Segment-Origin-ID", f"<{own}>"), ("WARC-Segment-Number", number)]
            if number == len(pieces):
                pairs.append(("WARC-Segment-Total-Length", len(block)))
        yield _headers([*pairs, ("Content-Length", len(piece))]) + piece


def revisits(pages: DataFrame, id_col: str, payload_col: str, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(id, digest, refers_to)`` of the pages whose payload belongs to a page of a smaller id."""
    payload = F.encode(F.col(payload_col), "utf-8")
    keys = cut_lineage(
        pages.where(F.octet_length(payload_col) >= least)
        .select(F.col(id_col).alias("id"), F.unhex(F.sha2(payload, 256)).alias("digest")), "payload-digests")
    shared = keys.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("refers_to")).where("n > 1")
    shared = cut_lineage(shared, "shared-payloads")
    often = F.col("n") > F.lit(keys.count() / 1000)  # true of fewer than a thousand digests
    hot, cold = shared.where(often), shared.where(~often)
    found = keys.join(F.broadcast(hot.drop("n")), "digest").unionByName(
        keys.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold.drop("n"), "digest"))
    return found.where("id <> refers_to").select("id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, per_file: int = RECORDS_PER_FILE) -> None:
    """One record, or one chain of segments, for each row."""
    ship_by_value()
    older = revisits(pages, id_col, payload_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.col(payload_col), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).join(older, ["id", "digest"], "left").select(
        F.col("id").cast("string"), "url", F.coalesce("payload", F.lit(b"")).alias("payload"), F.col("refers_to").cast("string"))

    def build(batches):
        n = 0
        for batch in batches:
            out = []
            for page, url, body, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                row = f"{TaskContext.get().partitionId()}-{n}"
                out += _records(page, row, url or "", body, hashlib.sha256(body).hexdigest(), refers, segment, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = rows.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.mode("errorifexists").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one should start")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        begin = head + 4
        end = begin + int(fields["content-length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError("a record of another length than stated")
        yield fields, data[begin:end]
        at = end + 4


def _name(field: str | None) -> str | None:
    """The page that a record id names."""
    return unquote(field[1:-1].removeprefix(_PREFIX).split(";")[0]) or None if field else None


def _record_row(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields["warc-type"]
    total = fields.get("warc-segment-total-length")
    number = fields.get("warc-segment-number")
    n_bytes = None
    if kind == "revisit":
        n_bytes = int(block.lower().split(b"content-length:")[1].split(b"\r\n")[0])
    origin = fields["warc-segment-origin-id"] if kind == "continuation" else fields["warc-record-id"]
    return (origin, _name(origin), int(number) if number else None, int(total) if total else None, kind,
            fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, _name(fields.get("warc-refers-to")), n_bytes, block)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``."""
    schema = _RECORD
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [_record_row(*r) for r in _parse(zlib.decompress(content.as_py(), wbits=47))]
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows[lo:lo + 256], strict=True), kinds, strict=True)], names=names)

    ship_by_value()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, schema)


def _decoded(block: bytes, digest: str | None) -> tuple[int, str, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    payload = dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body
    found = hashlib.sha256(payload).hexdigest()
    if digest and found != digest:
        raise ValueError("a payload of another digest than stated")
    return len(payload), found, payload


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per page: ``page, payload_bytes, payload_digest, record_type, refers_to`` (and ``payload``)."""
    records = read_records(spark, path)
    schema = "page string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][:len(names)]

    def decode(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == "revisit":
                    out.append((r["page"], r["n_bytes"], r["digest"], "revisit", r["refers"], None))
                    continue
                segments = r.get("segments")
                block, digest = r.get("block"), r.get("digest")
                if segments is not None:
                    segments.sort(key=lambda s: s["segment"])
                    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                        raise ValueError(f"missing or repeated segments of {r['page']}")
                    block, digest = b"".join(s["block"] for s in segments), segments[0]["digest"]
                    if len(block) != segments[-1]["total"]:
                        raise ValueError(f"the segments of {r['page']} do not add up to their total length")
                size, found, payload = _decoded(block, digest)
                out.append((r["page"], size, found, "response", None, payload if with_payload else None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    single = records.where("segment IS NULL").select("page", "kind", "digest", "refers", "n_bytes", "block")
    chains = records.where("segment IS NOT NULL").groupBy("origin", "page").agg(  # the segments of one row
        F.collect_list(F.struct("segment", "total", "digest", "block")).alias("segments"))
    chains = chains.select("page", F.lit("response").alias("kind"), "segments")
    return single.mapInArrow(decode, schema).unionByName(chains.mapInArrow(decode, schema))


def archive_path(spark: SparkSession) -> str:
    return scratch_path(spark, f"warc-{uuid.uuid4().hex}")
