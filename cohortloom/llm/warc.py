"""WARC archives as a Python data source, and a writer that stores equal payloads once.

Files hold one gzip member per record. The member's extra field carries its length (the ``sl``
skip-lengths field of the WARC standard's annex on compression), so a reader inflates the first block,
parses the header lines, and jumps over payloads it does not want. Foreign files without that field,
and uncompressed ones, are read too. A manifest written at commit names the files that count, so the
leftovers of failed or repeated tasks are never read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

from ..operators.scale import checkpointed

SMALL_PAYLOAD = 1000
FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
LEVEL = 3
MANIFEST = "_manifest"
DATE = "1970-01-01T00:00:00Z"

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_length long, payload binary"
)
# header line of each column that a predicate can be pushed to
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
_ARROW = pa.schema(
    [(n, pa.string()) for n in HEADERS] + [("payload_length", pa.int64()), ("payload", pa.binary())]
)


def _filesystem(path: str):
    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        # file:/x is as good as file:///x
        return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pyarrow.fs.LocalFileSystem(), path


def _clean(value: str) -> str:
    """Header values stay on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(record: dict) -> bytes:
    """One record in WARC/1.1 form; a revisit has no payload of its own."""
    payload = record["payload"] or b""
    revisit = record["record_type"] == "revisit"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
        f"Content-Length: {record['payload_length']}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", record["record_type"]),
        ("WARC-Record-ID", record["record_id"]),
        ("WARC-Date", record.get("date") or DATE),
        ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Payload-Digest", f"sha1:{record['payload_digest']}"),
        ("WARC-Refers-To", record["refers_to"]),
        (
            "WARC-Profile",
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        ),
        ("X-Payload-Length", str(record["payload_length"])),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in lines if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field holds its own and the inflated length."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 24 + len(body) + 8
    known = max(size, len(data)) < 1 << 32
    lengths = (size if known else 0).to_bytes(4, "little") + (len(data) if known else 0).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + (12).to_bytes(2, "little")
    tail = zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    return head + b"sl" + (8).to_bytes(2, "little") + lengths + body + tail


class _Inflated:
    """One gzip member, inflated as far as it is asked for."""

    def __init__(self, file, start: int):
        self.file, self.start = file, start
        file.seek(start)
        head = file.read(12)
        flags, self.size, extra = head[3], 0, b""
        if flags & 4:
            extra = file.read(int.from_bytes(head[10:12], "little"))
            if extra[:2] == b"sl":
                self.size = int.from_bytes(extra[4:8], "little")
            at = start + 12 + len(extra)
        else:
            at = start + 10
        for flag in (8, 16):
            if flags & flag:
                file.seek(at)
                while (c := file.read(1)) not in (b"\0", b""):
                    at += 1
                at += 1
        if flags & 2:
            at += 2
        self.at, self.inflate, self.data = at, zlib.decompressobj(-15), b""

    def more(self, size: int) -> bool:
        if self.inflate.eof:
            return False
        self.file.seek(self.at)
        chunk = self.file.read(size)
        self.at += len(chunk)
        self.data += self.inflate.decompress(chunk)
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
        return bool(chunk)

    def drop(self, size: int) -> None:
        """Forget the first ``size`` bytes, inflating what of them is still packed."""
        while len(self.data) < size:
            size -= len(self.data)
            self.data = b""
            if not self.more(1 << 16):
                return
        self.data = self.data[size:]

    def next(self, record: int) -> bool:
        """Go on to the record after one of ``record`` bytes, if the member holds another.

        A member with a length is one record; only others are inflated to their end.
        """
        if self.size:
            return False
        self.drop(record)
        self.data = self.data.lstrip(b"\r\n")
        while not self.data and self.more(1 << 16):
            self.data = self.data.lstrip(b"\r\n")
        return bool(self.data)

    def end(self, record: int) -> int:
        """Start of the next member."""
        if self.size:
            return self.start + self.size
        if not self.inflate.eof:
            raise ValueError(f"the archive ends inside the record at byte {self.start}")
        return self.at + 8


class _Plain:
    """An uncompressed record."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, b""

    def more(self, size: int) -> bool:
        self.file.seek(self.start + len(self.data))
        chunk = self.file.read(size)
        self.data += chunk
        return bool(chunk)

    def next(self, record: int) -> bool:
        return False

    def end(self, record: int) -> int:
        if self.start + record > self.file.size():
            raise ValueError(f"the archive ends inside the record at byte {self.start}")
        return self.start + record + 4


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _hex_digest(value: str | None) -> str | None:
    """``sha1:`` digests as lower-case hex, from hex or base 32."""
    if value is None:
        return None
    algorithm, _, digest = value.rpartition(":")
    if algorithm.lower() == "sha1" and len(digest) == 32:
        import base64

        return base64.b32decode(digest.upper()).hex()
    return digest.lower()


def read_records(file, wanted=lambda row: True, with_payload: bool = True) -> Iterator[dict]:
    """Rows of an open archive. Headers come first; only wanted records inflate their payload.

    A member may hold one record or many. An archive that ends inside a record is an error.
    """
    at, size = 0, file.size()
    member = None
    while at < size:
        if member is None:
            file.seek(at)
            member = (_Inflated if file.read(2) == b"\x1f\x8b" else _Plain)(file, at)
        record = member
        while b"\r\n\r\n" not in record.data and record.more(2048):
            pass
        head, _, _ = record.data.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = _fields(head)
        row = {c: fields.get(h) for c, h in HEADERS.items()}
        row["payload_digest"] = _hex_digest(row["payload_digest"])
        length = fields.get("x-payload-length")
        row["payload_length"] = int(length) if length is not None else None
        end = len(head) + 4 + int(fields.get("content-length", 0))
        if wanted(row):
            row["payload"] = None
            if with_payload and row["record_type"] != "revisit":
                while len(record.data) < end and record.more(1 << 16):
                    pass
                if len(record.data) < end:
                    raise ValueError(f"the archive ends inside the record at byte {at}")
                block = record.data[len(head) + 4 : end]
                if "application/http" in fields.get("content-type", ""):
                    block = block.partition(b"\r\n\r\n")[2]
                row["payload"] = block
                if row["payload_length"] is None:
                    row["payload_length"] = len(block)
            yield row
        if not member.next(end):
            at, member = member.end(end), None


def _manifests(fs, root: str) -> list[str]:
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(MANIFEST) and f.base_name.endswith(".json"))


@dataclass
class Files(InputPartition):
    paths: list[str]


def _matches(kind, value, row) -> bool:
    column, arg = value
    own = row[column]
    if kind == "null":
        return (own is None) == arg
    if own is None:
        return False
    return own.startswith(arg) if kind == "starts" else own in arg


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append(("in", (column, (f.value,))))
            elif isinstance(f, In):
                self.tests.append(("in", (column, tuple(f.value))))
            elif isinstance(f, StringStartsWith):
                self.tests.append(("starts", (column, f.value)))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.tests.append(("null", (column, isinstance(f, IsNull))))
            else:
                yield f

    def partitions(self):
        """Files packed into partitions by size; manifests, if there are any, say which files count."""
        fs, root = _filesystem(self.path)
        manifests = _manifests(fs, root)
        if manifests:
            files = []
            for manifest in manifests:
                with fs.open_input_stream(manifest) as f:
                    files += [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        elif fs.get_file_info(root).type == pyarrow.fs.FileType.File:
            files = [(root, 0)]
        else:
            found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
            files = [(f.path, f.size) for f in found if re.search(r"\.warc(\.gz)?$", f.path)]
        parts, total = [], 0
        for name, size in sorted(files):
            if not parts or total + size > self.partition_bytes:
                parts.append(Files([]))
                total = 0
            parts[-1].paths.append(name)
            total += size
        return parts or [Files([])]

    def read(self, partition):
        fs, _ = _filesystem(self.path)

        def wanted(row):
            return all(_matches(kind, value, row) for kind, value in self.tests)

        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for row in read_records(file, wanted, self.with_payload):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list


def _records(batches, rows: int = 200) -> Iterator[dict]:
    """Rows of Arrow batches, a few turned into Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield from batch.slice(lo, rows).to_pylist()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))

    def write(self, batches):
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for record in _records(batches):
            if out is None:
                # a name of its own: a repeated task never writes into another's file
                name = f"part-{uuid.uuid4().hex}.warc.gz"
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            member = gzip_member(record_bytes(record))
            out.write(member)
            size += len(member)
            if size >= self.file_bytes:
                out.close()
                files.append((name, size))
                out, size = None, 0
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages):
        """A manifest of its own per write: what earlier writes committed stays, unless overwritten."""
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        listed = sorted(f for m in messages if m is not None for f in m.files)
        earlier = _manifests(fs, root) if self.overwrite else []
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{root}/_new-{name}", compression=None) as f:
            f.write(json.dumps(listed).encode())
        # under its name only when it is whole
        fs.move(f"{root}/_new-{name}", f"{root}/{MANIFEST}-{name}.json")
        for manifest in earlier:
            with fs.open_input_stream(manifest) as f:
                old = json.loads(f.read())
            fs.delete_file(manifest)
            for file, _ in old:
                fs.delete_file(f"{root}/{file}")


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options: path, payload (true), partitionBytes, fileBytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it push predicates down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_id_of(record_id):
    return F.regexp_extract(record_id, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")


def page_records(pages: DataFrame, small: int = SMALL_PAYLOAD) -> DataFrame:
    """A record per row of ``pages`` (page_id, url, html): payloads from ``small`` bytes on once each.

    Of the rows with an equal payload that with the largest page_id is the response (of repeated rows
    with that id, all), the others revisit it. Null html is an empty payload. Where all equal payloads
    have a null page_id, all are responses; beside a row with an id they revisit it. Other columns of
    ``pages`` are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns(
        {"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")}
    )
    slim = rows.where(F.col("payload_length") >= small).select("page_id", "payload_digest")
    # hot payloads are counted before they are shuffled
    owners = slim.groupBy("payload_digest").agg(
        F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")
    )
    owners = owners.where("n > 1 and owner is not null").drop("n")
    repeats = slim.join(owners, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("owner")))
    repeats = checkpointed(repeats.distinct()).withColumnsRenamed(
        {"page_id": "rid", "payload_digest": "rdigest"}
    )
    both = rows.join(
        repeats,
        F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("payload_digest") == F.col("rdigest")),
        "left",
    )
    revisit = F.col("owner").isNotNull()

    def urn(c):
        return F.concat(F.lit("<urn:x-page:"), c, F.lit(">"))

    return both.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(
            urn(F.col("page_id").cast("string")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
        ).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        urn(F.col("owner").cast("string")).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
