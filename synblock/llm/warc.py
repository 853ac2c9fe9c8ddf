"""WARC archives as a PySpark Python data source.

Writing: each task writes one file under a name of its own attempt; the driver's commit lists
the files of the attempts that count in a manifest of its own, and readers read what all manifests list. A lost executor's half-written files
are therefore never read, and appending leaves what was there. Overwriting takes the manifests and files from before away once the new manifest is
there. Every record is a gzip member whose header has the ``sl`` (skip lengths)
field that the standard proposes.

Reading: one partition per file. Equality, IN and null predicates on the record type and the other header
columns are pushed down; a record's headers are inflated first and, if they don't satisfy the predicates,
the reader seeks to the next record without inflating or decoding its payload. The option ``payload=false`` skips
all payloads. Plain ``.warc`` files and gzip members without the field are read too.

Paths without a scheme are taken as Hadoop takes them (``read`` and ``archive`` complete them on the driver). Blocks of
records that aren't HTTP messages are payloads as they are.

Null payloads are written as empty ones, null ids and URLs leave their headers out. Control
characters in header values are percent-encoded. An empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage

from synblock import scratch

LEAST = 1000
NAME = "warc"
MANIFEST = "_manifest"
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_FIELDS = ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "payload_bytes", "payload")
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def _safe(s: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in s)


def record(kind: str, record_id: str | None, uri: str | None, date: str | None, digest: str | None, refers_to: str | None, length: int, payload: bytes) -> bytes:
    """One WARC/1.1 record. A revisit has its HTTP headers only; their Content-Length is that of the full payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block += b"" if kind == "revisit" else payload
    head = [f"WARC-Type: {kind}", f"WARC-Date: {date or _DATE}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if record_id is not None:
        head.append(f"WARC-Record-ID: <{_safe(record_id)}>")
    if uri is not None:
        head.append(f"WARC-Target-URI: {_safe(uri)}")
    if digest:
        head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_safe(refers_to or '')}>"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its own length and that of its content in an ``sl`` field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 10 + 14 + len(body) + 8
    if whole >= 1 << 32 or len(data) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, whole, len(data)) + body + tail


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    size: int
    records: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, plain: bool, overwrite: bool = False):
        self.path, self.plain, self.overwrite = path, plain, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        name, out, n, size = f"part-{uuid.uuid4().hex}.warc" + ("" if self.plain else ".gz"), None, 0, 0
        for b in iterator:
            for row in zip(*(b.column(c).to_pylist() for c in _FIELDS), strict=True):
                if out is None:
                    fs, at = _open(self.path)
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                data = record(row[0], *row[1:7], row[7] or b"")
                data = data if self.plain else member(data)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
        return _Written(name if n else None, size, n)

    def commit(self, messages: list) -> None:
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        before = [i.path for i in fs.get_file_info(arrow_fs.FileSelector(at)) if i.type == arrow_fs.FileType.File] if self.overwrite else []
        files = [{"file": m.file, "size": m.size, "records": m.records} for m in messages if m is not None and m.file]
        written = {x["file"] for x in files}
        with fs.open_output_stream(f"{at}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps({"files": files}).encode())
        old = [x for x in before if x.rsplit("/", 1)[-1] not in written]
        for x in sorted(old, key=lambda x: MANIFEST not in x.rsplit("/", 1)[-1]):  # manifests first
            if x.endswith((".warc", ".warc.gz")) or x.rsplit("/", 1)[-1].startswith(MANIFEST):
                fs.delete_file(x)

    def abort(self, messages: list) -> None:
        """Nothing: files that no manifest lists are not read."""


@dataclass
class _File(InputPartition):
    path: str


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        out[key.strip().lower()] = value.strip()
    return out


def _value(head: dict[str, str], column: str) -> str | None:
    v = head.get(HEADERS[column])
    if v is None:
        return None
    if column in ("record_id", "refers_to"):
        return v.removeprefix("<").removesuffix(">")
    if column == "payload_digest":
        v = v.removeprefix("sha1:")
        return base64.b32decode(v).hex() if len(v) == 32 else v.lower()
    return v


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: dict[str, set | None] = {}
        self.null: dict[str, bool] = {}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS or not isinstance(f, (EqualTo, In, IsNull, IsNotNull)):
                yield f
            elif isinstance(f, (IsNull, IsNotNull)):
                if self.null.setdefault(column, isinstance(f, IsNull)) != isinstance(f, IsNull):
                    self.wanted[column] = set()
            else:
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = some & self.wanted[column] if column in self.wanted else some

    def partitions(self) -> list[_File]:
        fs, at = _open(self.path)
        if fs.get_file_info(at).type == arrow_fs.FileType.File:
            return [_File(at)]
        found = sorted(i.path for i in fs.get_file_info(arrow_fs.FileSelector(at)) if i.type == arrow_fs.FileType.File)
        manifests = [x for x in found if x.rsplit("/", 1)[-1].startswith(MANIFEST)]
        names = [] if manifests else [x for x in found if x.endswith((".warc", ".warc.gz"))]  # an archive made elsewhere
        for x in manifests:
            with fs.open_input_stream(x) as f:
                names += [f"{at}/{y['file']}" for y in json.loads(f.read())["files"]]
        return [_File(n) for n in names]

    def _accepts(self, head: dict[str, str]) -> bool:
        return all(_value(head, c) in some for c, some in self.wanted.items()) and all((_value(head, c) is None) == none for c, none in self.null.items())

    def _row(self, head: dict[str, str], block: bytes | None) -> tuple:
        length, payload = None, None
        if block is not None and not head.get("content-type", "").lower().startswith("application/http"):
            stated = head.get("content-length", "")
            length, payload = int(stated) if stated.isdigit() else len(block), block if self.payload else None
        elif block is not None:
            http, _, payload = block.partition(b"\r\n\r\n")
            named = _headers(http)
            length = int(named["content-length"]) if named.get("content-length", "").isdigit() else len(payload)
            if not self.payload or head.get("warc-type") == "revisit":
                payload = None
        return (*(_value(head, c) for c in HEADERS), length, payload)

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # what Spark makes of an archive without files
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.path) as f:
            yield from self._members(f) if f.read(2) == b"\x1f\x8b" else self._plain(f)

    def _plain(self, f: pa.NativeFile) -> Iterator[tuple]:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            text = b""
            while b"\r\n\r\n" not in text and (more := f.read(2048)):
                text += more
            lead = len(text) - len(text.lstrip(b"\r\n"))
            stop = text.find(b"\r\n\r\n", lead)
            if stop < 0:
                return
            head = _headers(text[lead:stop])
            length, body = int(head.get("content-length", 0)), at + stop + 4
            if self._accepts(head):
                f.seek(body)
                yield self._row(head, f.read(length if self.payload else min(length, 8192)))
            at = body + length + 4

    def _members(self, f: pa.NativeFile) -> Iterator[tuple]:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            start = f.read(4096)
            if start[:2] != b"\x1f\x8b":
                return
            skip, whole = 10, None
            if start[3] & 4:
                n = struct.unpack("<H", start[10:12])[0]
                extra, skip = start[12 : 12 + n], 12 + n
                while len(extra) >= 4:
                    size = struct.unpack("<H", extra[2:4])[0]
                    if extra[:2] == b"sl" and size == 8:
                        whole = struct.unpack("<I", extra[4:8])[0]
                    extra = extra[4 + size :]
            for flag in (8, 16):
                if start[3] & flag:
                    skip = start.index(b"\0", skip) + 1
            skip += 2 if start[3] & 2 else 0
            inflate, data, given, more = zlib.decompressobj(-15), b"", len(start), start[skip:]

            def grow(most: int) -> bool:
                nonlocal more, given
                if inflate.eof:
                    return False
                if not more and not inflate.unconsumed_tail:
                    more = f.read(1 << 16)
                    given += len(more)
                    if not more:
                        return False
                part = inflate.decompress(inflate.unconsumed_tail + more, most)
                more = b""
                parts.append(part)
                return True

            parts: list[bytes] = []
            while b"\r\n\r\n" not in data and grow(2048):  # headers first
                data = b"".join(parts)
            head = _headers(data.partition(b"\r\n\r\n")[0])
            accepted = self._accepts(head)
            if accepted and (self.payload or head.get("warc-type") == "revisit"):
                while grow(1 << 20):
                    pass
            elif accepted:
                while sum(map(len, parts)) < len(data) + 4096 and grow(4096):
                    pass
            if accepted:
                block = b"".join(parts).partition(b"\r\n\r\n")[2]
                yield self._row(head, block[: int(head.get("content-length", len(block)))])
            if whole is None:  # no length given: the rest has to be inflated, and is thrown away
                while grow(1 << 20):
                    parts.clear()
                whole = given - len(inflate.unused_data) + 8
            at += whole


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; columns as in ``SCHEMA``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("compression", "gzip").lower() == "none", overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with predicates pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """A record per page, columns as in ``SCHEMA``: of equal payloads of ``least`` bytes or more, that with the largest id is a response and the others revisit it."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    # groups of two or more only; written, so that either side of the join has its exchange
    latest = rows.where(F.col("length") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("latest")).where("n > 1 and latest is not null").drop("n")
    latest = scratch.materialize(latest, "payloads")
    again = F.col("latest").isNotNull() & ~F.col("id").eqNullSafe(F.col("latest"))
    urn = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("urn:page:"), F.col(c).cast("string")))
    return rows.join(latest, "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn("id").alias("record_id"), F.col("uri").alias("target_uri"), F.lit(_DATE).alias("date"),
        F.col("digest").alias("payload_digest"), F.when(again, urn("latest")).alias("refers_to"), F.col("length").alias("payload_bytes"), F.when(~again, F.col("payload")).alias("payload"),
    )


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Hadoop gives it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def archive(pages: DataFrame, path: str, mode: str = "append", **columns) -> None:
    """Writes ``pages`` to WARC files at ``path``."""
    register(pages.sparkSession)
    records(pages, **columns).write.format(NAME).mode(mode).save(qualified(pages.sparkSession, path))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("payload", str(payload).lower()).load(qualified(spark, path))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` and tells from the archives alone what each record holds."""
    spark = pages.sparkSession
    path = scratch.new_path(spark, "warc")
    archive(pages, path)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).cast("long")
    full = read(spark, path).where("record_type = 'response'").select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read(spark, path, payload=False).where("record_type = 'revisit'").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return full.unionByName(again)


ORACLE = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to FROM m
"""
