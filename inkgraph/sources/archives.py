"""Article archives: tar, gzip'd tar, zip, gzip'd or plain XML files as one row a member, what can't be read kept aside with a reason.

Spark lists and reads the files (its binaryFile source, as a batch or as a stream), so any file system that Spark knows
will do and a stream that restarts goes on behind the files it has committed. A task goes through an archive member by
member. Files over `whole` bytes don't come as values: the task opens them itself and reads them as they unpack, which
needs a local path or a file system known to Arrow.

Each member is parsed once by an event parser, whose memory grows with the depth of the elements. That tells if the
member is well formed, its root, and where body and floats stand, so that the floats can be put into the body.

Columns: archive, member, xml, body, error, detail. error is null for articles; otherwise it is one of "unreadable
archive" (the members before the fault are kept), "not text", "not well formed" and "root is <name>", and detail has
the parser's words. xml has neither declaration nor document type; named entities of HTML are resolved.
Defined cases: Spark's file source passes over files of no bytes, and empty content is an unreadable archive; members that aren't .xml and folders are passed over; equal
names are separate rows; null content with no length is an unreadable archive.
"""

from __future__ import annotations

import gzip
import html
import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to so many bytes are read by Spark as one value.
WHOLE = 256 << 20
#: Bytes of members in a batch.
BATCH = 8 << 20
SCHEMA = "archive string, member string, xml string, body string, error string, detail string"
FLOATS = ("fig", "table-wrap")
_DECLARED = re.compile(rb"^\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']")
_PROLOG = re.compile(r"^﻿?\s*<\?xml.*?\?>", re.S)
_DOCTYPE = re.compile(r"<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>", re.S)
_EMPTY = re.compile(rb"<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>")
_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")


def _opened(path: str, content: bytes | None) -> BinaryIO:
    if content is not None:
        return io.BytesIO(content)
    if path.startswith("file:"):
        return open(path[5:].replace("///", "/", 1), "rb")
    from pyarrow.fs import FileSystem

    system, name = FileSystem.from_uri(path)
    return system.open_input_file(name)


def _members(path: str, content: bytes | None) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the .xml members, one after another; raises where the archive can't be read on."""
    name = path.rstrip("/").rpartition("/")[2]
    with _opened(path, content) as file:
        head = file.read(512)
        file.seek(0)
        if not head:
            raise ValueError("empty file")
        if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
            with zipfile.ZipFile(file) as zipped:
                for info in zipped.infolist():
                    if not info.is_dir() and info.filename.endswith(".xml"):
                        yield info.filename, zipped.read(info)
            return
        if head[:2] == b"\x1f\x8b":
            with gzip.open(file) as inner:
                first = inner.read(512)
            file.seek(0)
            if first.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"<":
                with gzip.open(file) as inner:
                    yield name.removesuffix(".gz"), inner.read()
                return
        elif head.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"<":
            yield name, file.read()
            return
        with tarfile.open(fileobj=file, mode="r|*") as tar:
            for member in tar:
                if member.isfile() and member.name.endswith(".xml"):
                    yield member.name, tar.extractfile(member).read()


def as_text(raw: bytes) -> str:
    """The XML as text without declaration and document type, named entities resolved; raises UnicodeError or LookupError."""
    found = _DECLARED.match(raw)
    encoding = found[1].decode() if found else "utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8"
    text = _DOCTYPE.sub("", _PROLOG.sub("", raw.decode(encoding).lstrip("﻿"), count=1), count=1)
    return _ENTITY.sub(lambda m: m[0] if m[1] in ("amp", "lt", "gt", "quot", "apos") else html.unescape(m[0]), text)


def parsed(text: str) -> tuple[str, str | None]:
    """(root, body): the name of the root, without prefix, and the body with its floats; raises expat.ExpatError.

    A float is a fig or table-wrap of the floats-group with an id; it takes the place of each empty xref with this id, figs
    before table-wraps and in their order, so an xref inside a float can be replaced as well.
    """
    raw = text.encode("utf-8")
    parser = expat.ParserCreate("utf-8")
    open_at: list[tuple[str, int, str | None, bool]] = []
    root: list[str] = []
    spans: list[tuple[str, int, int, str | None, bool]] = []

    def start(tag: str, attributes: dict) -> None:
        tag = tag.rpartition(":")[2]
        if not root:
            root.append(tag)
        inside = bool(open_at) and (open_at[-1][3] or open_at[-1][0] == "floats-group")
        open_at.append((tag, parser.CurrentByteIndex, attributes.get("id"), inside))

    def end(_: str) -> None:
        tag, begin, name, inside = open_at.pop()
        if tag == "body" or inside and name and tag in FLOATS:
            at = parser.CurrentByteIndex  # the place behind an empty element's tag, else that of the end tag
            empty = raw[at - 2 : at] == b"/>" and _EMPTY.fullmatch(raw, begin, at)
            spans.append((tag, begin, at if empty else raw.index(b">", at) + 1, name, inside))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(raw, True)
    bodies = [s for s in spans if s[0] == "body"]
    if not bodies:
        return root[0], None
    first = min(bodies, key=lambda s: s[1])
    body = raw[first[1] : first[2]].decode("utf-8")
    for kind in FLOATS:
        for _, begin, stop, name, _ in sorted(s for s in spans if s[0] == kind):
            content = raw[begin:stop].decode("utf-8")
            body = body.replace(f'<xref rid="{name}"/>', content).replace(f'<xref rid="{name}"></xref>', content)
    return root[0], body


def _judged(raw: bytes, root: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(xml, body, error, detail) of one member."""
    try:
        text = as_text(raw)
    except (UnicodeError, LookupError) as fault:
        return None, None, "not text", str(fault)
    try:
        name, body = parsed(text)
    except expat.ExpatError as fault:
        return text, None, "not well formed", str(fault)
    if root and name != root:
        return text, None, f"root is {name}", None
    return text, body, None, None


def read_members(archives: DataFrame, root: str | None = "article") -> DataFrame:
    """Rows of SCHEMA for all .xml members of archives (path, content); members with another root are kept aside unless root is None."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(6)], names=["archive", "member", "xml", "body", "error", "detail"])

        for path, content in ((p.as_py(), c.as_py()) for b in batches for p, c in zip(b.column(0), b.column(1))):
            try:
                for name, raw in _members(path, content):
                    rows.append((path, name, *_judged(raw, root)))
                    size += len(raw)
                    if size > BATCH:
                        yield batch()
                        rows.clear()
                        size = 0
            except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError, ValueError, NotImplementedError, zlib.error) as fault:
                rows.append((path, None, None, None, "unreadable archive", str(fault)))
        yield batch()

    return archives.select("path", "content").mapInArrow(unpack, SCHEMA)


def _files(reader, path: str) -> DataFrame:
    return reader.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_archives(spark: SparkSession, path: str, root: str | None = "article", whole: int = WHOLE) -> DataFrame:
    """Members of all files below a path."""
    files = _files(spark.read, path)
    # the content of large files is not asked for, so the source doesn't read it
    large = files.where(F.col("length") > whole).select("path", F.lit(None).cast("binary").alias("content"))
    return read_members(files.where(F.col("length") <= whole).select("path", "content").unionByName(large), root)


def stream_archives(spark: SparkSession, path: str, root: str | None = "article", files_a_batch: int = 100) -> DataFrame:
    """The same as a stream: each file once, so many files in a batch; the query's checkpoint says which files are done."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch)
    return read_members(_files(reader, path).select("path", "content"), root)


def checked(records: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of records with a column xml: good has all columns as they were but for xml as plain text, bad has error and detail as well.

    The test runs once for each of the two; write the records first where they are dear to make.
    """
    columns = records.columns
    at = columns.index("xml")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_judged((x or "").encode("utf-8", "replace"), root) for x in b.column(at).to_pylist()]
            arrays = [*b.columns, *(pa.array([f[k] for f in found], pa.string()) for k in (2, 3))]
            arrays[at] = pa.array([f[0] for f in found], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "error", "detail"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    rows = records.withColumn("xml", F.col("xml").cast("string")).mapInArrow(test, f"{schema}, error string, detail string")
    return rows.where("error IS NULL").select(*columns), rows.where("error IS NOT NULL")


def pack_archives(members: DataFrame, most: int = 100) -> DataFrame:
    """(path, content): members (name, xml) in archives of at most `most` members, by turns tar, gzip'd tar and zip."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0

        def archive(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
            out, kind = io.BytesIO(), count % 3
            if kind == 2:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zipped:
                    for name, raw in rows:
                        zipped.writestr(name, raw)
            else:
                with tarfile.open(fileobj=out, mode="w" if kind == 0 else "w:gz") as tar:
                    for name, raw in rows:
                        info = tarfile.TarInfo(name)
                        info.size = len(raw)
                        tar.addfile(info, io.BytesIO(raw))
            path = f"{rows[0][0]}{('.tar', '.tar.gz', '.zip')[kind]}"
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

        rows: list[tuple[str, bytes]] = []
        for b in batches:
            for name, xml in zip(b.column(0).to_pylist(), b.column(1)):
                rows.append((name, (xml.as_py() or "").encode("utf-8")))
                if len(rows) == most:
                    yield archive(rows)
                    rows, count = [], count + 1
        if rows:
            yield archive(rows)

    return members.select("name", "xml").mapInArrow(pack, "path string, content binary")
