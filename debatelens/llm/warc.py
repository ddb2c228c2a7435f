"""WARC archives as a Spark data source, and writing pages to them.

``read_warc`` plans partitions by file, takes filters on the header columns into the
scan, parses a record's headers first, and passes over the payloads of records that are
not wanted and of all records when the schema has no ``payload``.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from debatelens.llm.common import stored

#: Column of a record, and the header that holds it.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, headers map<string,string>, payload binary"
#: Bytes of small files that one task reads.
PARTITION_BYTES = 64 << 20
#: Records and payload bytes of one batch to Spark.
BATCH_RECORDS, BATCH_BYTES = 2048, 8 << 20
#: Records with smaller payloads are never revisits.
LEAST_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member's own length, as the extra field that the WARC standard recommends.
_EXTRA, _EXTRA_SIZE = "<2sHII", 12


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- records -----------------------------------------------------------------------


def member(record: bytes) -> bytes:
    """One record as one gzip member that tells its length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    length = 10 + 2 + _EXTRA_SIZE + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", _EXTRA_SIZE) + struct.pack(_EXTRA, b"sl", 8, length, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_headers(data: bytes) -> dict[str, str]:
    """Header names in lower case; lines that start with a blank continue the last one."""
    found: dict[str, str] = {}
    name = ""
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _length(headers: dict[str, str]) -> int | None:
    """Content-Length as a number; None if it is missing or is none."""
    value = headers.get("content-length", "")
    return int(value) if value.isascii() and value.isdigit() else None


_GZIP = b"\x1f\x8b"


def _head(file: io.BufferedReader) -> bytes:
    """The next two bytes, as far as there are any; the file's position stays."""
    seen = file.peek(2)[:2]
    if len(seen) == 1:  # the buffer ends here, the file need not
        at = file.tell()
        seen = file.read(2)
        file.seek(at)
    return seen


class _Plain:
    """Uncompressed records from the file's position on."""

    def __init__(self, file: io.BufferedReader) -> None:
        self.file = file

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        """The bytes up to the mark and with it, or all, or ``most`` if it is not in them."""
        data = bytearray()
        while mark not in data[-len(mark) - 2 :] and (most is None or len(data) < most):
            line = self.file.readline() if most is None else self.file.readline(most - len(data))
            if not line:
                break
            data += line
        return bytes(data)

    def take(self, n: int) -> bytes:
        return self.file.read(n)

    def skip(self, n: int) -> None:
        self.file.seek(n, io.SEEK_CUR)

    def ended(self) -> bool:
        return _head(self.file) in (b"", _GZIP)

    def close(self) -> None:
        pass


class _Member:
    """The gzip member at the file's position; it is unpacked as far as it is asked for."""

    CHUNK = 1 << 14

    def __init__(self, file: io.BufferedReader) -> None:
        self.file, self.start, self.length, self.whole, self.at = file, file.tell(), 0, -1, 0
        head = file.read(12 + _EXTRA_SIZE)
        if len(head) >= 12 and head[3] & 4 and struct.unpack_from("<H", head, 10)[0] >= _EXTRA_SIZE and head[12:14] == b"sl":
            _, _, self.length, self.whole = struct.unpack_from(_EXTRA, head, 12)
        self.unpacker = zlib.decompressobj(31)
        self.data = bytearray(self.unpacker.decompress(head))
        self.fed = len(head)

    def _more(self) -> bool:
        if self.unpacker.eof:
            return False
        chunk = self.file.read(self.CHUNK)
        if not chunk:
            return False
        self.fed += len(chunk)
        self.data += self.unpacker.decompress(chunk)
        return True

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        """The bytes up to the mark and with it, or all, or ``most`` if it is not in them."""
        seen = 0
        while (at := self.data.find(mark, max(0, seen - len(mark) + 1), most)) < 0:
            seen = len(self.data)
            if (most is not None and seen >= most) or not self._more():
                return self.take(len(self.data) if most is None else most)
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.data) < n and self._more():
            pass
        part = bytes(self.data[:n])
        del self.data[:n]
        self.at += len(part)
        return part

    def skip(self, n: int) -> None:
        if self.at + n + 4 == self.whole:  # the member's only or last record
            self.at = self.whole
            return
        while n > 0 and (part := self.take(min(n, self.CHUNK))):
            n -= len(part)

    def ended(self) -> bool:
        return self.at == self.whole or not (self.data or self._more())

    def close(self) -> None:
        if self.length and self.at == self.whole:
            self.file.seek(self.start + self.length)
        else:
            self.file.seek(self.start + self.fed - len(self.unpacker.unused_data))


def _record(part, headers: dict, left: int, payload: bool) -> tuple[int, bytes | None, int]:
    """(payload bytes, payload, bytes of the block that were not read) of one record."""
    inner, size = b"", left
    if "application/http" in headers.get("content-type", ""):
        inner = part.until(b"\r\n\r\n", left)
        left -= len(inner)
        if inner.endswith(b"\r\n\r\n"):
            stated = _length(parse_headers(inner))
            size = stated if headers.get("warc-type") == "revisit" and stated is not None else left
            inner = b""
    if not payload:
        return size, None, left
    return size, inner + part.take(left), 0


def read_records(file: io.BufferedReader, wanted, payload: bool, http: bool) -> Iterator[tuple[dict, int | None, bytes | None]]:
    """(headers, payload bytes, payload) of the records whose headers are ``wanted``.

    Records may lie in the file plainly, each in its own gzip member, or several in one. The
    payload's length is that of what the block holds behind the HTTP headers, if it has any;
    a revisit has the length that its HTTP headers name. Neither length nor payload is looked
    at unless asked for.

    Malformed input: a record without a readable Content-Length has neither payload nor its
    length, and reading goes on at the next line that begins a record. A block without an end
    of its HTTP headers is payload as a whole. An HTTP length that is no number, or in a
    response any, is not believed. A file cut off inside a record gives the bytes that are
    there. Damaged gzip data are an error.
    """
    while head := _head(file):
        part = _Member(file) if head == _GZIP else _Plain(file)
        while not part.ended():
            lines = part.until(b"\r\n\r\n")
            start = 0 if lines.startswith(b"WARC/") else lines.find(b"\nWARC/") + 1
            if not lines.startswith(b"WARC/", start):  # blank lines between records, or what is no record
                continue
            headers = parse_headers(lines[start:])
            left = _length(headers)
            size = body = None
            if wanted(headers):
                if left is not None and (http or payload):
                    size, body, left = _record(part, headers, left, payload)
                yield headers, size, body
            part.skip(left or 0)
        part.close()


# --- the data source ---------------------------------------------------------------


@dataclass
class FileGroup(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], schema: pa.Schema) -> None:
        self.path, self.columns, self.schema = path, columns, schema
        self.equal: list[tuple[str, frozenset]] = []
        self.starts: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, lists, beginnings and presence of the header columns are checked here."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.equal.append((HEADERS[name], frozenset([f.value])))
            elif isinstance(f, In):
                self.equal.append((HEADERS[name], frozenset(f.value)))
            elif isinstance(f, StringStartsWith):
                self.starts.append((HEADERS[name], f.value))
            elif isinstance(f, IsNotNull):
                self.starts.append((HEADERS[name], ""))
            else:
                yield f

    def partitions(self) -> list[FileGroup]:
        store, path = _files(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = [f for f in found if f.is_file and f.base_name[:1] not in "_." and f.base_name.endswith((".warc", ".warc.gz"))]
        groups: list[FileGroup] = []
        held = PARTITION_BYTES
        for f in sorted(files, key=lambda f: f.path):
            if held + f.size > PARTITION_BYTES:
                groups.append(FileGroup([]))
                held = 0
            groups[-1].paths.append(f.path)
            held += f.size
        return groups or [FileGroup([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        if any(headers.get(name) not in values for name, values in self.equal):
            return False
        return all(name in headers and headers[name].startswith(value) for name, value in self.starts)

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        store, _ = _files(self.path)
        rows: list[list] = []
        held = 0
        payload, http = "payload" in self.columns, "payload_bytes" in self.columns
        for path in partition.paths:
            with store.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 17) as file:
                for headers, size, body in read_records(file, self.wanted, payload, http):
                    own = {"payload_bytes": size, "payload": body, "headers": list(headers.items())}
                    rows.append([own[c] if c in own else headers.get(HEADERS[c]) for c in self.columns])
                    held += len(body or b"")
                    if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(self.columns)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)


@dataclass
class Written(WriterCommitMessage):
    path: str


class WarcWriter(DataSourceArrowWriter):
    """One file per task, moved to its place when all tasks are done; a task that is run
    again writes another file, and what was left behind is never read."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _files(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.run}.warc.gz"
        store.create_dir(f"{path}/_temporary-{self.run}", recursive=True)
        target = f"{path}/_temporary-{self.run}/{task.taskAttemptId()}-{name}"
        info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE}
        info |= {"WARC-Filename": name, "Content-Type": "application/warc-fields"}
        with store.open_output_stream(target, compression=None) as out:
            out.write(member(record(info, b"format: WARC File Format 1.1\r\n")))
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(member(self._record(row)))
        return Written(target)

    @staticmethod
    def _record(row: dict) -> bytes:
        revisit = row["record_type"] == "revisit"
        payload = row["payload"] or b""
        # bytes of a line break in an address would end the header
        uri = None if row["target_uri"] is None else row["target_uri"].replace("\r", "%0D").replace("\n", "%0A")
        headers = {
            "WARC-Type": row["record_type"],
            "WARC-Record-ID": row["record_id"],
            "WARC-Date": row.get("date") or DATE,
            "WARC-Target-URI": uri,
            "WARC-Payload-Digest": row["payload_digest"],
            "WARC-Refers-To": row["refers_to"],
            "WARC-Profile": REVISIT_PROFILE if revisit else None,
            "Content-Type": "application/http; msgtype=response",
        }
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return record(headers, http if revisit else http + payload)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _files(self.path)
        kept = {m.path.rsplit("/", 1)[1].split("-", 1)[1] for m in messages if m}
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and f.base_name not in kept:
                    store.delete_file(f.path)
        for m in messages:
            if m:
                store.move(m.path, f"{path}/{m.path.rsplit('/', 1)[1].split('-', 1)[1]}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, path = _files(self.path)
        left = f"{path}/_temporary-{self.run}"
        if store.get_file_info(left).type == fs.FileType.Directory:
            store.delete_dir(left)


class WarcSource(DataSource):
    """Format ``warc``; the path is a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        unknown = set(schema.names) - set(HEADERS) - {"payload_bytes", "headers", "payload"}
        if unknown:
            raise ValueError(f"records have no {sorted(unknown)}")
        return WarcReader(self.options["path"], schema.names, to_arrow_schema(schema))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of the archives below ``path``. Name the columns that are needed:
    without ``payload`` and ``payload_bytes`` only headers are read."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kinds = dict(c.strip().split(" ", 1) for c in SCHEMA.split(", "))
    chosen = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("warc").schema(chosen).load(path)


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def page_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT
) -> DataFrame:
    """The columns that ``write_warc`` needs, one record per row of ``pages``.

    Of records with equal payloads of at least ``least`` bytes the largest id is the
    response (repeated rows of it all are), the others revisit it. A null html is an empty
    payload; a record without an id is a response and named ``none``.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= least).groupBy("digest")
    owners = long.agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    # stored, so that Spark sees its size: few owners are broadcast, many are joined by digest
    owners = stored(owners.select(F.col("digest").alias("owned"), "owner"), "owners")
    rows = rows.join(owners, (F.col("digest") == F.col("owned")) & (F.octet_length("payload") >= least), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("owner"), F.lit(False))
    return rows.select(
        _urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("target_uri").cast("string").alias("target_uri"),
        F.when(revisit, _urn(F.col("owner"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        "payload",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (see ``page_records``) as compressed archives, one file per task."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(path)


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
