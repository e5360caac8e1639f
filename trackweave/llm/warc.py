"""WARC archives: a Python data source that writes and reads them, and deduplicating archives of pages.

Reading: each archive is a partition (a payload may hold what looks like a record, so an archive is never cut at guessed
starts; writers make an archive per task). A record's headers are parsed first; if a pushed record type or header predicate rules it out, or if the wanted
columns don't need it, its payload is skipped (by a seek in plain archives), not decoded or digested.
Filters on record_type, record_id, target_uri, refers_to, payload_digest and content_length are pushed down; the options `record_types` (comma-separated) and `header`
(name=value) do the same for any session.

Writing: a record per row, each its own gzip member (`compression` gzip or none), a file per task attempt under
a name of its own; the driver renames the files of the attempts that succeeded, so lost executors and
repeated tasks leave no half or double archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from trackweave.llm.common import settled, shared_dir

HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, content_type string, content_length long, payload_bytes long, computed_digest string, payload binary"
#: Columns that need the bytes of the payload.
BODY = {"computed_digest", "payload"}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = schema.fieldNames()
        self.options = options
        self.tests: list[tuple[str, object]] = []
        if options.get("record_types"):
            wanted = set(options["record_types"].split(","))
            self.tests.append(("record_type", ("in", wanted)))
        if options.get("header"):
            name, _, value = options["header"].partition("=")
            self.tests.append((name.lower(), ("in", {value})))

    def pushFilters(self, filters):
        kinds = {EqualTo: "=", EqualNullSafe: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "set"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in kinds and column in (*HEADERS, "content_length") and not (type(f) is EqualNullSafe and f.value is None):
                self.tests.append((column, (kinds[type(f)], set(f.value) if type(f) is In else getattr(f, "value", None))))
            else:
                yield f

    def partitions(self):
        fs, path = opened(self.options["path"])
        out = []
        infos = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)) if fs.get_file_info(path).type != pafs.FileType.File else [fs.get_file_info(path)]
        for info in sorted(infos, key=lambda i: i.path):
            name = info.path.rsplit("/", 1)[-1]
            if info.type == pafs.FileType.File and not name.startswith(("_", ".")):
                out.append(Archive(info.path))
        return out or [Archive("")]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = opened(self.options["path"])
        with fs.open_input_file(partition.path) as f:
            source = _Members(f) if partition.path.endswith(".gz") else _Plain(f)
            names = self.columns
            body = bool(BODY & set(names))
            for headers in source:
                row = {c: headers.get(h) for c, h in HEADERS.items()}
                written = headers.get("content-length", "0")
                length = row["content_length"] = int(written) if written.isascii() and written.isdigit() else 0  # of none that can be read, reading goes on at the next line that starts a record
                if not all(_passes(test, row[c] if c in row else headers.get(c)) for c, test in self.tests):
                    source.skip(length)
                    continue
                http = (row["content_type"] or "").startswith("application/http")
                if body or http and "payload_bytes" in names:
                    head, taken, payload = source.block(length, http, body)
                    written = head.get("content-length", "")
                    named = row["record_type"] == "revisit" and written.isascii() and written.isdigit()  # a revisit names the length of what it leaves out
                    row["payload_bytes"] = int(written) if named else length - taken
                    row["payload"] = payload
                    row["computed_digest"] = digest(payload) if "computed_digest" in names and payload is not None and row["record_type"] != "revisit" else None
                else:
                    source.skip(length)
                    row["payload_bytes"] = length
                if source.short:
                    continue  # damaged or cut off
                yield tuple(row.get(c) for c in names)


def _passes(test, value) -> bool:
    kind, other = test
    if value is None:
        return False
    return {"=": lambda: value == other, "in": lambda: value in other, ">": lambda: value > other, ">=": lambda: value >= other, "<": lambda: value < other, "<=": lambda: value <= other, "set": lambda: True}[kind]()


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:]) if k}


class _Stream:
    """Headers of the records in turn; between two, skip() or block() takes the record's block."""

    #: Bytes of a line, and of a record's headers, that are held at most; headers beyond are passed over.
    HEAD = 1 << 20

    #: Whether the last record's block had fewer bytes than it should, and whether the archive was damaged on the way.
    short = broken = False

    def head(self) -> dict[str, str] | None:
        while True:
            lines, size, self.short, self.broken = [], 0, False, False
            while (line := self.line()) and not line.startswith(b"WARC/"):
                pass  # blank lines between records, and what stands behind a record of unknown length
            while line.strip():
                if size < self.HEAD:
                    lines.append(line.rstrip(b"\r\n"))
                size += len(line)
                line = self.line()
            if not self.broken:
                return _fields(b"\r\n".join(lines)) if lines else None

    def block(self, length: int, http: bool, body: bool) -> tuple[dict[str, str], int, bytes | None]:
        """The HTTP head's fields, its bytes, and the rest of the block, if wanted."""
        taken, head = 0, {}
        if http:
            lines = []
            while taken < length:
                line = self.line()
                taken += len(line)
                self.short |= not line
                if not line.strip():
                    break
                lines.append(line.rstrip(b"\r\n"))
            head = _fields(b"\r\n".join(lines))
        payload = self.take(length - taken) if body else self.skip(length - taken)
        self.short |= body and len(payload) < length - taken
        return head, taken, payload


class _Plain(_Stream):
    """Records of a plain archive."""

    def __init__(self, f):
        self.buffer, self.size = io.BufferedReader(f, 1 << 18), f.size()

    def line(self):
        return self.buffer.readline(self.HEAD)

    def take(self, n):
        return self.buffer.read(n)

    def skip(self, n):
        self.short |= self.buffer.seek(n, 1) > self.size

    def __iter__(self):
        while (head := self.head()) is not None:
            yield head


class _Members(_Stream):
    """Records of an archive of gzip members, inflated as they are read. Where a member is damaged, reading goes on at the next one, and the record it was in is left out."""

    START = b"\x1f\x8b\x08"

    def __init__(self, f):
        self.f, self.z, self.data, self.raw = f, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            raw = self.raw or self.f.read(1 << 18)
            try:
                got = self.z.decompress(raw, 1 << 22)
            except zlib.error:
                self.resume(raw)
                return False
            self.raw = self.z.unconsumed_tail
            if got:
                self.data += got
                return True
            if not raw:
                return False

    def resume(self, raw: bytes) -> None:
        """Behind a damage, to what looks like the start of a member."""
        self.broken, raw = True, raw[1:]
        while (i := raw.find(self.START)) < 0 and (more := self.f.read(1 << 18)):
            raw = raw[-2:] + more
        self.raw, self.z, self.data = raw[i:] if i >= 0 else b"", zlib.decompressobj(31), b""

    def line(self):
        while (i := self.data.find(b"\n")) < 0:
            if len(self.data) >= self.HEAD or not self.more():
                out, self.data = self.data, b""
                return out
        out, self.data = self.data[: i + 1], self.data[i + 1 :]
        return out

    def take(self, n):
        parts, have = [self.data[:n]], min(n, len(self.data))
        self.data = self.data[n:]
        while have < n and self.more():
            parts.append(self.data[: n - have])
            self.data = self.data[n - have :]
            have += len(parts[-1])
        return b"".join(parts)

    def skip(self, n):
        while n > len(self.data):
            n -= len(self.data)
            self.data = b""
            if not self.more():
                self.short = True
                return
        self.data = self.data[n:]

    def __iter__(self):
        while (head := self.head()) is not None:
            yield head


@dataclass
class Written(WriterCommitMessage):
    name: str
    temporary: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.gzip = options["path"], options.get("compression", "gzip") == "gzip"
        self.level = int(options.get("level", 3))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, path = opened(self.path)
        fs.create_dir(f"{path}/_attempts", recursive=True)
        token = uuid.uuid4().hex
        temporary = f"{path}/_attempts/{token}"
        part = TaskContext.get().partitionId()
        n = 0
        with fs.open_output_stream(temporary) as out:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("record_id", "record_type", "target_uri", "warc_date", "refers_to", "payload")]
                for record in zip(*columns, strict=True):
                    data = record_bytes(*record)
                    if self.gzip:
                        z = zlib.compressobj(self.level, wbits=31)
                        data = z.compress(data) + z.flush()
                    out.write(data)
                    n += 1
        return Written(f"part-{part:05d}-{token[:8]}.warc" + ".gz" * self.gzip, temporary, n)

    def commit(self, messages):
        fs, path = opened(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.temporary, f"{path}/{m.name}")
        fs.delete_dir_contents(f"{path}/_attempts", missing_dir_ok=True)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages):
        fs, path = opened(self.path)
        fs.delete_dir_contents(f"{path}/_attempts", missing_dir_ok=True)


def _line(text: str) -> str:
    """A header value on one line: controls and the space at its ends are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text).strip()


def record_bytes(record_id: str, record_type: str, target_uri: str | None, date: str, refers_to: str | None, payload: bytes | None) -> bytes:
    """A response with its payload as an HTTP response, or a revisit with only the HTTP headers."""
    payload = payload or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    head = f"WARC/1.1\r\nWARC-Type: {record_type}\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: {date}\r\n"
    if target_uri:
        head += f"WARC-Target-URI: {_line(target_uri)}\r\n"
    if record_type == "revisit":
        head += f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {refers_to}\r\n"
    head += f"WARC-Payload-Digest: sha1:{digest(payload)}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def archive_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_revisit: int = 0, compression: str = "gzip") -> None:
    """Writes pages (page_id, url, html) as WARC records; a null html is an empty payload, a null url has no target.

    Of equal payloads of least_revisit bytes or more the one of the smallest page_id is a response (all rows of it, if the row is repeated), the others revisit it;
    a null page_id is the response only of a payload that no other has.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    x = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")).withColumn("_sha", F.unhex(F.sha1("payload")))
    firsts = x.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("_sha", "_first")
    x = x.join(settled(firsts), "_sha", "left")
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.length("payload") >= least_revisit)
    rows = x.select(uri("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.when(again, uri("_first")).alias("refers_to"), "payload")
    rows.write.format("warc").option("compression", compression).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, **options: str) -> DataFrame:
    """Records of the archives under a path; name only the columns that are needed, as payloads are read for `payload` and `computed_digest` only.

    Turns on spark.sql.python.filterPushdown.enabled, without which Spark reads no Python source that takes filters.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(columns).options(**options).load(path)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives pages and reads the archives back: page_id, payload_bytes, payload_digest (of a response computed from what was read), record_type, refers_to."""
    spark = pages.sparkSession
    path = f"{(folder or shared_dir(spark)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archive_pages(pages, path)
    back = read_warc(spark, path, "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long, computed_digest string")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", F.coalesce("computed_digest", F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
