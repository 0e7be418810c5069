"""WARC archives: a Python data source that writes and reads them.

Each record is a gzip member of its own whose header carries the member's and
the content's length (extra field 'sl'), so a reader can pass over a member
without inflating it. The reader plans partitions from the manifest, byte ranges
of about `SPLIT_BYTES` that begin at a record, takes filters on record type and
header columns, inflates and parses a record's headers first, and leaves the
payload alone if the record is not wanted or the payload column is not asked for
(option `payload`). Folders without a manifest are searched for .warc and
.warc.gz files from elsewhere, one partition each; their members may lack the
lengths.

Of records with equal payloads of `dedup_min` bytes or more, that with the
smallest page_id is the response; others are revisits without a payload, with
the payload's digest and length in their headers. Null html is an empty
payload. A null page_id is never the response of others; if no equal payload
has a page_id, all are responses. Rows that repeat the smallest page_id are
responses too. An empty table gives an archive folder without files, which reads
back as no rows; columns other than page_id, url and html are left out. Null URLs have no target header and come back null; characters
that a header line can't hold come back as written by percent-decoding.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .components import splittable
from .storage import open_fs, qualified

SCHEMA = "record_type string, page_id long, url string, date string, payload_digest string, payload_bytes long, refers_to long, payload binary"
HEADER_COLUMNS = {"record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to"}
URN = "urn:page:"
#: Bytes of inflated data that surely hold a record's headers; more is read if not.
HEAD_BYTES = 4096
#: Compressed bytes read from a file at once; bytes of a file in an input partition.
CHUNK, HEAD_CHUNK, SPLIT_BYTES = 4 << 20, 128 << 10, 64 << 20


def member(content: bytes, level: int) -> bytes:
    """One gzip member with its own and the content's length in the extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(content) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(content) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def header_lines(record_type: str, page_id: int | None, url: str | None, digest: str, payload_bytes: int, refers_to: int | None, date: str, length: int) -> bytes:
    ref = f"<{URN}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, digest)}>"
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {ref}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {payload_bytes}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~' + chr(39))}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict:
    """Values by column, and content_length."""
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()

    def number(ref: str | None) -> int | None:
        ref = (ref or "").strip("<>")
        return int(ref[len(URN) :]) if ref.startswith(URN) else None

    uri = fields.get("warc-target-uri")
    digest = fields.get("warc-payload-digest", "")
    return {
        "record_type": fields.get("warc-type"), "page_id": number(fields.get("warc-record-id")), "url": None if uri is None else unquote(uri), "date": fields.get("warc-date"),
        "payload_digest": digest.removeprefix("sha256:") or None, "payload_bytes": int(fields.get("x-payload-bytes", fields.get("content-length", 0))), "refers_to": number(fields.get("warc-refers-to")),
        "content_length": int(fields.get("content-length", 0)),
    }


class Records:
    """Walks an archive's records; each gives its headers, then its payload on request.

    Members with their length are passed over without inflating more than the
    headers; members without it are inflated to their end, as only that tells
    where the next begins, but kept only on request; plain records are skipped by
    their content length.
    """

    def __init__(self, source, size: int | None = None, chunk: int = CHUNK):
        self.chunk = chunk  #: bytes read at once; fewer where most are to be passed over
        self.source, self.data, self.at = source, b"", 0
        self.left = size  #: bytes of the source that are ours; None: all
        self.ahead = 0  #: bytes of the member at the current place, if it was looked at and not taken

    def need(self, n: int) -> bool:
        """Have `n` bytes at hand from the current place, reading on as necessary."""
        if self.at > self.chunk:
            self.data, self.at = self.data[self.at :], 0
        while len(self.data) - self.at < n:
            wanted = max(self.chunk, n - (len(self.data) - self.at))
            more = self.source.read(wanted if self.left is None else min(wanted, self.left))
            if not more:
                return False
            if self.left is not None:
                self.left -= len(more)
            self.data += more
        return True

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise ValueError("an archive ends within a record")
        self.at += n
        return self.data[self.at - n : self.at]

    def skip(self, n: int) -> None:
        """Pass over `n` bytes; those that are not at hand are not read."""
        more = n - (len(self.data) - self.at)
        if more <= 0:
            self.at += n
            return
        if self.left is not None:
            if more > self.left:
                raise ValueError("an archive ends within a record")
            self.left -= more
        self.source.seek(more, 1)
        self.data, self.at = b"", 0

    def __iter__(self) -> Iterator[tuple[dict, callable]]:
        while self.need(1):
            if self.need(24) and self.data[self.at : self.at + 4] == b"\x1f\x8b\x08\x04" and self.data[self.at + 12 : self.at + 14] == b"sl":
                yield self.sized_member()
                if self.ahead:
                    self.skip(self.ahead)
                    self.ahead = 0
            elif self.data[self.at : self.at + 2] == b"\x1f\x8b":
                yield from self.member()
            elif self.need(5) and self.data[self.at : self.at + 5] == b"WARC/":
                yield from self.plain()
            elif self.data[self.at : self.at + 1] in b"\r\n":
                self.at += 1
            else:
                raise ValueError("neither a record nor a gzip member")

    def sized_member(self) -> tuple[dict, callable]:
        """Headers from the first bytes of a member; the rest is read only for its payload."""
        (size,) = struct.unpack("<I", self.data[self.at + 16 : self.at + 20])
        inflate, head, upto, given = zlib.decompressobj(-15), b"", 24, b""
        while (end := head.find(b"\r\n\r\n")) < 0:
            if not given:  # a little more of the member
                if inflate.eof or upto >= size - 8:
                    raise ValueError("a record without headers")
                following = min(size - 8, max(HEAD_BYTES, upto * 4))
                if not self.need(following):
                    raise ValueError("an archive ends within a record")
                given, upto = self.data[self.at + upto : self.at + following], following
            head += inflate.decompress(given, HEAD_BYTES)
            given = inflate.unconsumed_tail
        fields = parse_headers(head[:end])
        self.ahead = size

        def payload() -> bytes:
            whole, self.ahead = self.take(size), 0
            content = zlib.decompress(whole[24:-8], -15)
            if (zlib.crc32(content), len(content) & 0xFFFFFFFF) != struct.unpack("<II", whole[-8:]):
                raise ValueError("a damaged record")
            return content[end + 4 : end + 4 + fields["content_length"]]

        return fields, payload

    def member(self) -> Iterator[tuple[dict, callable]]:
        inflate = zlib.decompressobj(31)
        content = b""

        def more() -> bytes:
            """Some more of the content; b'' once the member has ended."""
            while not inflate.eof:
                if not self.need(1):
                    raise ValueError("an archive ends within a record")
                given = self.data[self.at :]
                out = inflate.decompress(given, HEAD_BYTES * 16)
                left = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                self.at += len(given) - len(left)
                if out:
                    return out
            return b""

        while (end := content.find(b"\r\n\r\n")) < 0:
            got = more()
            if not got:
                raise ValueError("a record without headers")
            content += got
        fields = parse_headers(content[:end])

        def payload() -> bytes:
            parts = [content]
            while got := more():
                parts.append(got)
            return b"".join(parts)[end + 4 : end + 4 + fields["content_length"]]

        yield fields, payload
        while more():
            pass

    def plain(self) -> Iterator[tuple[dict, callable]]:
        size = HEAD_BYTES
        while True:
            full = self.need(size)
            end = self.data.find(b"\r\n\r\n", self.at, self.at + size)
            if end >= 0 or not full:
                break
            size *= 2
        if end < 0:
            raise ValueError("a record without headers")
        fields = parse_headers(self.data[self.at : end])
        self.take(end + 4 - self.at)
        taken = []

        def payload() -> bytes:
            taken.append(self.take(fields["content_length"]))
            return taken[0]

        yield fields, payload
        if not taken:
            left = fields["content_length"]
            while left:  # pass over it in parts
                left -= len(self.take(min(left, CHUNK)))


@dataclass
class Archive(WriterCommitMessage):
    name: str
    records: int
    size: int
    cuts: list[int]  #: offsets of records at which input partitions begin


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date, self.level = options["path"], options.get("date", "2024-01-01T00:00:00Z"), int(options.get("level", "1"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Archive:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        records, size, cuts = 0, 0, [0]
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to", "payload")), strict=True):
                    *fields, payload = row
                    payload = payload or b""
                    data = member(header_lines(*fields, self.date, len(payload)) + payload + b"\r\n\r\n", self.level)
                    if size - cuts[-1] >= SPLIT_BYTES:
                        cuts.append(size)
                    out.write(data)
                    records, size = records + 1, size + len(data)
        return Archive(name, records, size, cuts)

    def commit(self, messages: list[Archive | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest.json") as out:
            out.write(json.dumps({"files": [m.__dict__ for m in messages if m and m.records]}).encode())

    def abort(self, messages: list[Archive | None]) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            if m and fs.get_file_info(f"{root}/{m.name}").is_file:
                fs.delete_file(f"{root}/{m.name}")


@dataclass
class ArchivePart(InputPartition):
    name: str
    start: int = 0
    size: int | None = None  #: bytes from the start; None: to the end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.with_payload, self.names = options["path"], options.get("payload", "true") == "true", schema.names
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.wanted.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f  # Spark applies it

    def partitions(self) -> list[ArchivePart]:
        fs, root = open_fs(self.path)
        if fs.get_file_info(f"{root}/_manifest.json").is_file:
            with fs.open_input_stream(f"{root}/_manifest.json") as f:
                files = json.loads(f.read())["files"]
            parts = [ArchivePart(x["name"], a, b - a) for x in files for a, b in zip(x["cuts"], [*x["cuts"][1:], x["size"]], strict=True)]
        else:  # archives from elsewhere
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            parts = [ArchivePart(n) for n in sorted(i.path[len(root) :].lstrip("/") for i in found if i.is_file and i.path.endswith((".warc", ".warc.gz")))]
        return parts or [ArchivePart("")]

    def read(self, part: ArchivePart) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        fs, root = open_fs(self.path)
        types = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        types = pa.schema([types.field(n) for n in self.names])
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(f"{root}/{part.name}") as f:
            f.seek(part.start)
            for fields, payload in Records(f, part.size, CHUNK if self.with_payload else HEAD_CHUNK):
                if not all(fields[c] in values for c, values in self.wanted):
                    continue
                if self.with_payload and fields["record_type"] != "revisit":
                    fields["payload"] = payload()
                    held += len(fields["payload"])
                rows.append(fields)
                if len(rows) >= 5000 or held >= CHUNK:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in types.names} for r in rows], types)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in types.names} for r in rows], types)


class Warc(DataSource):
    """`geoloom_warc`: options path, payload (true or false), date, level (deflate)."""

    @classmethod
    def name(cls) -> str:
        return "geoloom_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def as_records(pages: DataFrame, *, dedup_min: int = 100) -> DataFrame:
    """Pages as rows of the archive: type, digest and reference of each.

    The smallest page_id of each digest is found with partial aggregation and
    joined to rows without payloads, whose hot digests adaptive execution can split.
    Payloads then meet only the rows of their own (digest, page), a key that a
    payload shared by a third of all pages spreads over.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256), "_url": F.xxhash64("url")})
    narrow = rows.where(f"payload_bytes >= {int(dedup_min)}").select("payload_digest", "page_id", "_url")
    firsts = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").drop("n")
    again = narrow.join(splittable(firsts, "payload_digest"), "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    again = again.select(F.col("payload_digest").alias("_digest"), F.col("page_id").alias("_page"), F.col("_url").alias("_own_url"), F.col("first_id").alias("refers_to"))
    again = splittable(again, "_digest").distinct()  # by all columns, not where the join left them
    same = (rows["payload_digest"] == again["_digest"]) & rows["page_id"].eqNullSafe(again["_page"]) & (rows["_url"] == again["_own_url"])
    return rows.join(again, same, "left").select(
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        "page_id", "url", "payload_digest", "payload_bytes", "refers_to",
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, *, dedup_min: int = 100) -> None:
    """Write a record for every page; each task one archive file."""
    pages.sparkSession.dataSource.register(Warc)
    as_records(pages, dedup_min=dedup_min).write.format("geoloom_warc").mode("append").option("path", qualified(pages.sparkSession, path)).save()


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """All records; filters on header columns reach the reader.

    Turns on `spark.sql.python.filterPushdown.enabled`, without which Spark filters after the reader.
    """
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("geoloom_warc").option("path", qualified(spark, path)).option("payload", str(payload).lower()).load()
