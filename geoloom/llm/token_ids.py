"""Token ids of whole texts, written as length-delimited binary records.

A data file holds frames of one record each:

    length of the payload   8 bytes, little-endian
    masked checksum of the length's bytes, 4 bytes
    payload                 doc_id (8 bytes, signed), flags (1 byte), ids
    masked checksum of the payload, 4 bytes

Flags: 1 if ids take 4 bytes each (else 2), 2 if the doc_id is null. A checksum
is CRC-32 rotated right by 15 bits plus a constant, so that a checksum of data
that holds checksums stays meaningful. The index file beside a data file has one
24-byte entry a record: frame offset, ids before it in the file, ids in it; a
shuffled read takes entries in any order and seeks. `_manifest.json`, written
only when every task has finished, lists the files in order with their totals,
so that files of failed attempts are never read.

Nulls count as empty texts. Documents with equal doc_ids are all written, in
order of their text's hash; a null doc_id comes first. An empty table gives a
manifest without files and reads back as no rows.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import segments as seg
from .storage import open_fs, qualified

MASK_DELTA = 0xA282EAD8
INDEX = np.dtype([("at", "<u8"), ("before", "<u8"), ("n", "<u8")])
WIDE, NULL_ID = 1, 2
#: Bytes of text encoded at once by a writing task, and of the words it remembers.
WRITE_BYTES, CACHE_BYTES = 8 << 20, 256 << 20
#: Bytes of a data file in an input partition, and of records in a batch, about.
SPAN_BYTES, READ_BYTES = 64 << 20, 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int) -> tuple[memoryview, int]:
    """Payload at an offset and the offset of the next frame; ValueError if damaged."""
    view = memoryview(data)
    head = view[at : at + 8]
    (size,) = struct.unpack("<Q", head)
    payload = view[at + 12 : at + 12 + size]
    if struct.unpack("<I", view[at + 8 : at + 12])[0] != masked(head):
        raise ValueError(f"damaged length at {at}")
    if len(payload) != size or struct.unpack("<I", view[at + 12 + size : at + 16 + size])[0] != masked(payload):
        raise ValueError(f"damaged record at {at}")
    return payload, at + 16 + size


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack("<qB", doc_id or 0, WIDE * wide | NULL_ID * (doc_id is None)) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack("<qB", payload[:9])
    return None if flags & NULL_ID else doc_id, np.frombuffer(payload[9:], "<u4" if flags & WIDE else "<u2")


#: Letters whose folding and composed form are the same everywhere, and punctuation that forms one run.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Steps before the merges for which a plain word is one unit of the model. Fixed values.
PLAIN_STEPS = ({"NFC", "Replace", "Lowercase"}, {"Split", "ByteLevel"})


def byte_letters() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies (a public convention)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    return out | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)}


class WordEncoder:
    """Ids of Arrow strings with a tokenizer that drops white space.

    Where the splitting pattern matches no white space, ids of a text are those of
    its words one after the other; other tokenizers get whole texts. A word of
    plain letters, and the punctuation after it, are units of the library's model
    by themselves, so they go to it directly; all other words go through the
    library's whole chain.
    """

    def __init__(self, tokenizer_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.by_word = ids(" \n \n") == [] and ids("a b\nc") == ids("a") + ids("b") + ids("c")
        config = json.loads(self.tokenizer.to_str())
        steps = [{x["type"] for x in (config[k] or {}).get("normalizers" if k == "normalizer" else "pretokenizers", [])} for k in ("normalizer", "pre_tokenizer")]
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs: dict[str, bytes] = {}  # punctuation after words
        tried = ["word", "Straße", "ÉTÉ", "it,", "end.***", "ñandú|"]
        self.cached = seg.SegmentCache(self.encode_words, CACHE_BYTES)
        self.direct = tuple(steps) == PLAIN_STEPS and self.by_word and all(self.plain(w) == seg.packed(ids(w)) for w in tried)

    def unit(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize(text if text.isascii() else "".join(self.letters[b] for b in text.encode()))]

    def plain(self, word: str) -> bytes | None:
        """Packed ids of a plain word, or None if it isn't one."""
        found = PLAIN_WORD.fullmatch(word)
        if not found:
            return None
        stem, run = found[1].lower(), found[2]
        if not run:
            return seg.packed(self.unit(stem))
        ids = self.cached.young.get(stem) or self.cached.old.get(stem) or seg.packed(self.unit(stem))
        after = self.runs.get(run)
        if after is None:
            after = seg.packed(self.unit(run))
            if len(self.runs) < 10_000:
                self.runs[run] = after
        return ids + after

    def encode_words(self, words: list[str]) -> list[bytes]:
        out = [self.plain(w) for w in words] if self.direct else [None] * len(words)
        rest = [k for k, x in enumerate(out) if x is None or any(s in words[k] for s in self.specials)]
        for start in range(0, len(rest), 5_000):
            part = rest[start : start + 5_000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = seg.packed(e.ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids."""
        if self.direct:  # the library folds these letters anyway; fewer distinct words
            folded = pc.ascii_lower(texts)
            if not any(pc.any(pc.match_substring(folded, s)).as_py() for s in self.specials):
                texts = folded
        if self.by_word:
            offsets, flat = seg.words(texts)
        else:
            offsets, flat = np.arange(len(texts) + 1), texts
        coded = flat.dictionary_encode()
        first, ids = seg.unpacked(self.cached(coded.dictionary.to_pylist()))
        lengths, values = seg.ragged_take(first, ids, coded.indices.to_numpy().astype(np.int64))
        return np.concatenate([[0], np.cumsum(seg.segment_sums(lengths, offsets))]).astype(np.int64), values


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    records: int
    ids: int
    cuts: list[int]  #: records at which input partitions begin


class TokenWriter(DataSourceArrowWriter):
    """Encodes and writes one data file and one index file a task."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.tokenizer = options["path"], options["tokenizer"]
        self.end = [int(x) for x in options.get("end_ids", "").split(",") if x]
        self.names = schema.names

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        encode, end = encoder(self.tokenizer).encode, np.array(self.end, np.int64)
        seg.take_over("token_ids")
        at = total = 0
        entries: list[tuple[int, int, int]] = []
        cuts, last_cut = [0], 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}.rec") as out:
            for batch in seg.byte_balanced(batches, "text", WRITE_BYTES):
                offsets, ids = encode(seg.large_text(batch.column("text")))
                frames = []
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                    own = np.concatenate([ids[a:b], end])
                    if at - last_cut >= SPAN_BYTES:
                        cuts.append(len(entries))
                        last_cut = at
                    frames.append(frame(pack(doc_id, own)))
                    entries.append((at, total, len(own)))
                    at += len(frames[-1])
                    total += len(own)
                out.write(b"".join(frames))
        with fs.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(np.array(entries, INDEX).tobytes())
        return Written(part, name, len(entries), total, cuts)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files = [{"name": m.name, "records": m.records, "ids": m.ids, "cuts": m.cuts} for m in sorted((m for m in messages if m), key=lambda m: m.part) if m.records]
        with fs.open_output_stream(f"{root}/_manifest.json") as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for suffix in ("rec", "idx") if m else ():
                if fs.get_file_info(f"{root}/{m.name}.{suffix}").is_file:
                    fs.delete_file(f"{root}/{m.name}.{suffix}")


@dataclass
class TokenSpan(InputPartition):
    name: str
    first: int  #: index entries of the file from here
    stop: int  #: up to here
    before: int  #: ids in the files before this one


class TokenReader(DataSourceReader):
    """Input partitions and batches follow bytes; a record larger than either stands alone."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[TokenSpan]:
        spans, before = [], 0
        for f in manifest(self.path):
            spans += [TokenSpan(f["name"], a, b, before) for a, b in zip(f["cuts"], [*f["cuts"][1:], f["records"]], strict=True)]
            before += f["ids"]
        return spans or [TokenSpan("", 0, 0, 0)]

    def read(self, span: TokenSpan) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(self.path)
        if not span.name:
            return
        with fs.open_input_file(f"{root}/{span.name}.idx") as f:
            f.seek(span.first * INDEX.itemsize)
            index = np.frombuffer(f.read((span.stop - span.first) * INDEX.itemsize), INDEX)
        with fs.open_input_file(f"{root}/{span.name}.rec") as f:
            f.seek(int(index["at"][0]))
            edges = [0]
            while edges[-1] < len(index):  # records of about READ_BYTES, one at least
                upto = int(np.searchsorted(index["at"], index["at"][edges[-1]] + np.uint64(READ_BYTES)))
                edges.append(max(edges[-1] + 1, upto))
            for first, stop in zip(edges[:-1], edges[1:], strict=True):
                part, begin = index[first:stop], int(index["at"][first])
                if stop == len(index):  # the last frame's length is in its head
                    tail = f.read(int(part["at"][-1]) - begin + 12)
                    (size,) = struct.unpack("<Q", tail[-12:-4])
                    data = tail + f.read(size + 4)
                else:
                    data = f.read(int(index["at"][stop]) - begin)
                doc_ids, payloads, at = [], [], 0
                for _ in part:
                    payload, at = unframe(data, at)
                    doc_id, ids = unpack(payload)
                    doc_ids.append(doc_id)
                    payloads.append(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(part["before"].astype(np.int64) + span.before), pa.array(part["n"].astype(np.int64)), pa.array(payloads, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def manifest(path: str) -> list[dict]:
    fs, root = open_fs(path)
    with fs.open_input_stream(f"{root}/_manifest.json") as f:
        return json.loads(f.read())["files"]


class TokenFiles(DataSource):
    """`geoloom_tokens`: options path and, to write, tokenizer and end_ids (comma-separated).

    Writes frames with doc_id and text; reads doc_id, start (ids of all documents
    before), n_tokens and ids (little-endian unsigned 32-bit integers).
    """

    @classmethod
    def name(cls) -> str:
        return "geoloom_tokens"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema: T.StructType) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, schema)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, end_ids: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents to `path` in ascending order of their ids.

    One range shuffle of (id, text) by id and text hash, so that null or equal ids
    spread as well; each task sorts its range and encodes while it writes, so
    neither ids nor texts gather anywhere.
    """
    docs.sparkSession.dataSource.register(TokenFiles)
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.format("geoloom_tokens").mode("append").option("path", qualified(docs.sparkSession, path)).option("tokenizer", tokenizer_path).option("end_ids", ",".join(map(str, end_ids))).save()


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every record."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("geoloom_tokens").option("path", qualified(spark, path)).load()


def read_record(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the whole order, through the index (a shuffled read)."""
    fs, root = open_fs(path)
    for f in manifest(path):
        if number < f["records"]:
            with fs.open_input_file(f"{root}/{f['name']}.idx") as x:
                x.seek(number * INDEX.itemsize)
                entry = np.frombuffer(x.read(INDEX.itemsize), INDEX)[0]
            with fs.open_input_file(f"{root}/{f['name']}.rec") as x:
                x.seek(int(entry["at"]))
                head = x.read(12)
                return unpack(unframe(head + x.read(struct.unpack("<Q", head[:8])[0] + 4), 0)[0])
        number -= f["records"]
    raise IndexError(number)
