"""Web archives: a converter from legacy ARC files to WARC, a WARC writer and a WARC reader.

The ARC parser goes by each record's header line and its declared length. Version 1 lines hold
URL, IP address, date, content type and length; version 2 lines hold URL, IP address, date, content
type, result code, checksum, location, offset, file name and length. The version comes from the
version block at the start of a file.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.llm.common import small_batches
from inkgraph.plans.scratch import scratch

END = b"\r\n\r\n"
#: Payloads under so many bytes are never revisits.
LEAST_REVISIT = 100
#: Copies of the table of repeated digests that a join is salted with.
SALTS = 16


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str  # YYYYMMDDhhmmss
    mime: str
    body: bytes
    version: int


def arc_file(records: list[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file with its version block."""
    fields = b"URL IP-address Archive-date Content-type Archive-length" if version == 1 else b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    block = b"%d 0 inkgraph\n%s\n" % (version, fields)
    out = [_arc_line(ArcRecord(f"filedesc://{name}", "0.0.0.0", "19960923142103", "text/plain", b"", version), len(block), 0, name), block, b"\n"]
    at = sum(map(len, out))
    for r in records:
        line = _arc_line(r, len(r.body), at, name)
        out += [line, r.body, b"\n"]
        at += len(line) + len(r.body) + 1
    return b"".join(out)


def _arc_line(r: ArcRecord, length: int, at: int, name: str) -> bytes:
    url = r.url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "-"
    middle = "" if r.version == 1 else f" 200 - - {at} {name}"
    return f"{url} {r.ip or '0.0.0.0'} {r.date} {r.mime or 'no-type'}{middle} {length}\n".encode()


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records behind the version block, each as long as its header line says."""
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if not line:  # the line end between two records
            at += 1
            continue
        fields = line.split(" ")
        if len(fields) not in (5, 10) or not fields[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {line[:80]!r}")
        first, length = end + 1, int(fields[-1])
        if end < 0 or first + length > len(data):
            raise ValueError(f"the ARC record at byte {at} is cut off")
        body = data[first : first + length]
        at = first + length
        if fields[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            continue
        if len(fields) != (5 if version == 1 else 10):
            raise ValueError(f"not a version-{version} header line: {line[:80]!r}")
        yield ArcRecord(fields[0], fields[1], fields[2], fields[3], body, version)


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or a shorter form filled up with the first month, day and midnight, as an ISO timestamp."""
    full = arc_date[:14] + "00000101000000"[len(arc_date[:14]) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(url: str, arc_date: str, key: object) -> str:
    """The same record gets the same identifier each time it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {arc_date} {key}')}>"


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """Status line and headers (with the empty line), and payload. A body without them is all payload."""
    if body.startswith(b"HTTP/"):
        cut = body.find(END)
        if cut >= 0:
            return body[: cut + 4], body[cut + 4 :]
    return b"", body


def warc_record(kind: str, ident: str, url: str, date: str, ip: str, head: bytes, payload: bytes, digest: str, refers_to: tuple[str, str] | None = None, extra: str = "", mime: str = "text/html") -> bytes:
    """Header and block of a response, resource or revisit record, without the two line ends behind it. mime: content type of a block without HTTP head."""
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}"]
    if ip and ip != "0.0.0.0":
        lines.append(f"WARC-IP-Address: {ip}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to[0]}", f"WARC-Refers-To-Target-URI: {refers_to[1]}"]
    lines += [extra] if extra else []
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else mime or 'application/octet-stream'}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def warcinfo(ident: str, date: str) -> bytes:
    """The record a file begins with, without the two line ends behind it."""
    block = b"software: inkgraph\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {ident}", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def read_warc(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, by declared lengths.

    pieces: what lies between double line ends, in order, of one file or of several. Blocks may hold
    double line ends; no more than a record and a piece is in memory.
    """
    held = bytearray()
    head: dict[str, str] | None = None
    length = 0
    for piece in pieces:
        held += piece
        held += END
        while True:
            if head is None:
                while held.startswith(END):  # the last piece of a file has no double line end of its own
                    del held[:4]
                cut = held.find(END)
                if cut < 0:
                    break
                if not held.startswith(b"WARC/1."):
                    raise ValueError(f"no WARC record: {bytes(held[:80])!r}")
                lines = held[:cut].decode("utf-8", "replace").split("\r\n")
                head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                length = int(head["content-length"])
                del held[: cut + 4]
            if len(held) < length + 4:
                break
            if held[length : length + 4] != END:
                raise ValueError(f"the WARC record {head.get('warc-record-id')} has another length than declared")
            yield head, bytes(held[:length])
            del held[: length + 4]
            head = None
    if head is not None or held:
        raise ValueError("the last WARC record is cut off")


# Spark side

_CONVERTED = "page_id long, url string, ip string, date string, version int, head binary, payload binary, payload_bytes long, payload_digest string, mime string"


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as legacy ARC files of either version, parsed again and given WARC dates and digests."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("version", pa.int32()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("mime", pa.string())])
    for batch in batches:
        by_version: dict[int, list[ArcRecord]] = {1: [], 2: []}
        for page, url, html in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            payload = html or b""
            version = 1 + (page or 0) % 2
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n".encode()
            second = (page or 0) % 86400
            date = f"20240101{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"
            by_version[version].append(ArcRecord(url or "", "0.0.0.0", date, "text/html", head + payload, version))
        rows = []
        for version, records in by_version.items():
            for r in read_arc(arc_file(records, version)):
                head, payload = http_parts(r.body)
                ident = head.rpartition(b"X-Page-Id: ")[2].strip()
                rows.append((int(ident) if ident else None, r.url, r.ip, r.date, r.version, head, payload, len(payload), hashlib.sha256(payload).hexdigest(), r.mime))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def convert_pages(pages: DataFrame) -> DataFrame:
    """Pages put into ARC records, which the converter parses: page_id, url, ip, date, version, head, payload, payload_bytes, payload_digest, mime."""
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html")).mapInArrow(_converted, _CONVERTED)


def with_revisits(converted: DataFrame) -> DataFrame:
    """Adds refers_to (page_id), its url and its date: of equal payloads of at least 100 bytes, all but the smallest page_id refer to it.

    Digests are counted with partial sums first. Only those that more than one record has are joined
    back, on digest and a salt, so a digest that a third of the rows share goes to several tasks.
    """
    known = converted.where((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    first = known.groupBy("payload_digest").agg(F.min(F.struct("page_id", "url", "date")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("payload_digest", F.col("first.page_id").alias("_page"), F.col("first.url").alias("_url"), F.col("first.date").alias("_date"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = converted.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, ["payload_digest", "_salt"], "left")
    # the first of rows that share the smallest page_id cannot be told apart: all of them stay responses
    refers = (F.col("_page").isNotNull()) & (F.col("page_id") > F.col("_page")) & (F.col("payload_bytes") >= LEAST_REVISIT)
    return joined.select(*converted.columns, F.when(refers, F.col("_page")).alias("refers_to"), F.when(refers, F.col("_url")).alias("refers_url"), F.when(refers, F.col("_date")).alias("refers_date"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a file, which begins with a warcinfo record. What has no HTTP head is a resource of its own content type."""
    begun = False
    for batch in batches:
        out = []
        for page, url, ip, date, _, head, payload, n, digest, mime, refers, refers_url, refers_date in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            ident = record_id(url, date, page)
            if not begun:
                out.append(warcinfo(record_id(ident, date, "warcinfo"), warc_date(date)))
                begun = True
            to = None if refers is None else (record_id(refers_url, refers_date, refers), refers_url)
            extra = f"X-Page-Id: {'' if page is None else page}\r\nX-Payload-Length: {n}" + ("" if refers is None else f"\r\nX-Refers-To-Page-Id: {refers}")
            kind = "revisit" if refers is not None else "response" if head else "resource"
            out.append(warc_record(kind, ident, url, warc_date(date), ip, head, payload, digest, to, extra, mime))
        yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["value"])


def write_warc(records: DataFrame, path: str) -> None:
    """Writes .gz files of WARC records, one a task, the two line ends behind each record being the writer's line separator."""
    small_batches(records.sparkSession)
    values = records.mapInArrow(_records, "value binary").select(F.col("value").cast("string").alias("value"))
    values.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("mime", pa.string())])
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for head, block in read_warc(piece for batch in batches for piece in batch.column(0).to_pylist()):
        kind = head["warc-type"]
        if kind == "warcinfo":
            continue
        digest, size = head["warc-payload-digest"].partition(":")[2], int(head["x-payload-length"])
        if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].partition(":")[2]:
            raise ValueError(f"block digest of {head['warc-record-id']}")
        if kind != "revisit":
            payload = http_parts(block)[1] if kind == "response" else block
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        to = head.get("x-refers-to-page-id")
        page = head["x-page-id"].strip()
        rows.append((int(page) if page else None, size, digest, kind, int(to) if to else None, head["warc-record-id"], head["warc-target-uri"], head["warc-date"], head["content-type"]))
        if len(rows) == 1000:
            yield out()
            rows = []
    if rows:
        yield out()


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, warcinfo ones left out, of the .gz files that write_warc makes. A file is one task's work, of which a record at a time is in memory."""
    small_batches(spark)
    pieces = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string, mime string"
    return pieces.mapInArrow(_parsed, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages through ARC into WARC files in the shared folder, and the records read back from there.

    One row for each page. Null html is an empty payload; a null url is written as "-"; a null page_id
    stays null and is always a response. Repeated rows are records of their own: those that share the
    smallest page_id of a payload are all responses. Other columns are not read. No pages: no rows.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(with_revisits(convert_pages(pages)), path)
    return read_warc_files(spark, path)
