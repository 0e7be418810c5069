"""SentencePiece encoding and decoding that keeps byte offsets.

`Normaliser` applies a model's compiled character map by longest prefix (a
double-array trie in front of the replacement strings) and records for every
normalised byte which source byte it came from. Stretches in which no entry of
the map can begin are copied at once; an empty map has only such. The library
segments the text; each piece's place in the normalised text is then projected
through that record to a span of bytes of the original text.

Models whose pieces never join a non-space to a following white space, and whose
character map is empty, are encoded by distinct segments (see `segments.py`),
each of them normalised, aligned and projected once; all others text by text.
A piece of one byte of a character spans that byte; pieces of a replaced stretch
begin at it.

Nulls count as empty texts, which have no pieces and decode to ''. Repeated rows
give repeated results; a kept column whose name clashes with a result is
replaced by the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import segments as seg

SPACE = "▁".encode()
BPE = 2
KIND_UNKNOWN, KIND_USER, KIND_BYTE = 2, 4, 6


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else (({1: 8, 5: 4}[kind]), at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Normaliser:
    """Text to normalised bytes, with the source byte of each of them."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True, as_suffix: bool = False, user_symbols: list[bytes] = ()):
        self.dummy_prefix, self.squeeze, self.as_suffix = dummy_prefix, squeeze, as_suffix
        self.space = SPACE if escape else b" "
        self.symbols = sorted(user_symbols, key=len, reverse=True)
        self.trie, self.strings = [], b""
        #: Bytes with which an entry of the map, or a symbol, begins.
        self.begins = np.zeros(256, bool)
        self.begins[[s[0] for s in self.symbols if s]] = True
        if charsmap:
            size = int.from_bytes(charsmap[:4], "little")
            self.trie = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist()
            self.strings = charsmap[4 + size :]
            root = self.jump(self.trie[0])
            for byte in range(1, 256):
                if root ^ byte < len(self.trie) and self.trie[root ^ byte] & 0x800000FF == byte:
                    self.begins[byte] = True

    @staticmethod
    def jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length and value of the longest entry of the map at `at`; length 0 if none."""
        trie, found = self.trie, (0, 0)
        if not trie:
            return found
        node = self.jump(trie[0])
        for n in range(at, len(data)):
            node ^= data[n]
            if node >= len(trie):
                break
            unit = trie[node]
            if unit & 0x800000FF != data[n]:
                break
            node ^= self.jump(unit)
            if unit >> 8 & 1:
                found = (n + 1 - at, trie[node] & 0x7FFFFFFF)
        return found

    def replacement(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """What the map, or a symbol, puts for what stands at `at`, and how many source bytes that covers."""
        for symbol in self.symbols:
            if data.startswith(symbol, at):
                return symbol, len(symbol)
        length, value = self.longest(data, at)
        return (self.strings[value : self.strings.index(b"\0", value)], length) if length else None

    def mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the map; for each its source and the place of its unit (a replacement, or a byte that stands for itself)."""
        raw = np.frombuffer(data, np.uint8)
        places = np.flatnonzero(self.begins[raw]) if self.begins.any() else raw[:0]
        if not len(places):  # one stretch
            at = np.arange(len(raw))
            return raw, at, at
        parts, sources, units, at, length = [], [], [], 0, 0

        def copy(stop: int) -> None:
            nonlocal length
            if stop > at:
                parts.append(raw[at:stop])
                sources.append(np.arange(at, stop))
                units.append(np.arange(length, length + stop - at))
                length += stop - at

        for place in places.tolist():
            found = self.replacement(data, place) if place >= at else None
            if found:
                copy(place)
                new = np.frombuffer(found[0], np.uint8)
                parts.append(new)
                sources.append(np.full(len(new), place))
                units.append(np.full(len(new), length))
                length, at = length + len(new), place + found[1]
        copy(len(data))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, sources, units))

    def aligned(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Bytes after the map, blanks written as the model's space, and the source byte of each and of the end."""
        out, source, _ = self.mapped(data)
        return self.spelled(out, source, len(data))

    def spelled(self, out: np.ndarray, source: np.ndarray, end: int) -> tuple[bytes, np.ndarray]:
        return out.tobytes().replace(b" ", self.space), np.append(np.repeat(source, np.where(out == 32, len(self.space), 1)), end)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end its source offset."""
        out, source, unit = self.mapped(data)
        if self.squeeze:
            blank = out == 32
            others = np.cumsum(~blank)
            front = blank & (others == others[unit] - ~blank[unit])  # nothing but blanks before it in its unit
            if not len(out) or (front & (unit == np.arange(len(out)))).all():
                return b"", np.array([len(data)])  # nothing but blanks
            again = front & ((unit == 0) | (out[unit - 1] == 32))
            out, source = out[~again], source[~again]
        elif not data:
            return b"", np.array([0])
        first = source[:1] if self.squeeze else np.zeros(1, np.int64)
        text, at = self.spelled(out, source, len(data))
        if self.dummy_prefix and not self.as_suffix:
            text, at = self.space + text, np.concatenate([np.repeat(first if len(first) else at[:1], len(self.space)), at])
        if self.squeeze:
            while text.endswith(self.space):
                text, at = text[: -len(self.space)], at[: -len(self.space)]
        if self.dummy_prefix and self.as_suffix:
            text, at = text + self.space, np.append(at, np.repeat(at[-1:], len(self.space)))
        return text, at


class PieceModel:
    """One model file: ids, original byte spans and decoded texts of Arrow strings."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        spec: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        texts, kinds = [], []
        for field, value in wire_fields(self.library.serialized_model_proto()):
            if field == 1:
                piece = dict(wire_fields(value))
                texts.append(piece.get(1, b""))
                kinds.append(piece.get(3, 1))
            elif field == 2:
                trainer = dict(wire_fields(value))
            elif field == 3:
                spec = dict(wire_fields(value))
        user = [t for t, k in zip(texts, kinds, strict=True) if k == KIND_USER]
        charsmap = bytes(spec.get(2, b""))
        self.normaliser = Normaliser(charsmap, bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), bool(trainer.get(24, 0)), user)
        #: Bytes of normalised text behind each id; -1 where only the library can tell.
        self.width = np.array([1 if k == KIND_BYTE else -1 if k == KIND_UNKNOWN else len(t) for t, k in zip(texts, kinds, strict=True)])
        lone = [i for i, t in enumerate(texts) if t == SPACE]
        self.lone_space = lone[0] if lone else -1
        blended = any(b"\n" in t or self.joins_space(t) for t, k in zip(texts, kinds, strict=True) if k != KIND_BYTE)
        plain = not charsmap and not user and spec.get(4, 1) == 0 and spec.get(3, 1) and spec.get(5, 1) and not trainer.get(24, 0)
        self.cuttable = bool(plain and trainer.get(3, 1) == BPE and lone and not blended and (self.width >= 0).sum() == len(texts) - 1 and KIND_BYTE in kinds)
        self.cached = seg.SegmentCache(self.encode_segments)

    @staticmethod
    def joins_space(piece: bytes) -> bool:
        """Whether a piece holds a non-space with a space mark after it."""
        text = piece.decode("utf-8", "replace")
        return "▁" in text.lstrip("▁")

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids of segments that start with a blank (the library's own prefix) or another space."""
        ids = self.library.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        # after its blank an empty rest means a lone space mark, which the library drops for ''
        return [seg.packed([self.lone_space] if s == " " else i if s[0] == " " else i[1:]) for s, i in zip(segments, ids, strict=True)]

    def one(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids and spans of one text through the character map."""
        if not text:
            return [], [], []
        ids = self.library.encode(text)
        _, source = self.normaliser(text.encode())
        width = self.width[ids] if ids else np.zeros(0, np.int64)
        if (width < 0).any():
            proto = self.library.encode(text, out_type="proto")
            width = np.array([w if w >= 0 else len(p.piece.encode()) for w, p in zip(width.tolist(), proto.pieces, strict=True)])
        ends = np.cumsum(width)
        return ids, source[ends - width].tolist(), source[ends].tolist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets into ids, ids, span starts and span ends, for all texts one after the other."""
        whole = np.ones(len(texts), bool)
        if self.cuttable:
            whole = pc.match_substring_regex(texts, "[\\x00\\x1f▁]").to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.encode_cut(texts)
        results: dict[int, tuple] = {int(i): self.one(texts[int(i)].as_py()) for i in np.flatnonzero(whole)}
        rest = np.flatnonzero(~whole)
        if len(rest):
            offsets, *parts = self.encode_cut(texts.take(pa.array(rest)))
            for k, i in enumerate(rest):
                results[int(i)] = tuple(p[offsets[k] : offsets[k + 1]] for p in parts)
        rows = [results[i] for i in range(len(texts))]
        offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows], dtype=np.int64)]).astype(np.int64)
        return offsets, *(np.concatenate([np.asarray(r[k], np.int32) for r in rows]) if rows else np.zeros(0, np.int32) for k in range(3))

    def encode_cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n_bytes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, flat = seg.cut(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), " \\n")
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        distinct = coded.dictionary.to_pylist()
        first, ids = seg.unpacked(self.cached(distinct))
        counts = np.diff(first)
        # spans within the distinct segments, all of them laid end to end
        size = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        _, source = self.normaliser.aligned("".join(distinct).encode())
        upto = np.cumsum(self.width[ids])
        begins, ends = source[upto - self.width[ids]], source[upto]
        start = np.repeat(np.cumsum(size) - size, counts)
        ends, begins = ends - start, begins - start
        # spread to the texts
        lengths, all_ids = seg.ragged_take(first, ids, index)
        seg_at = np.cumsum(size[index]) - size[index]
        text_at = seg_at[offsets[:-1]] if len(seg_at) else np.zeros(0, np.int64)
        within = np.repeat(seg_at - np.repeat(text_at, np.diff(offsets)), lengths) - 1
        _, all_begins = seg.ragged_take(first, begins, index)
        _, all_ends = seg.ragged_take(first, ends, index)
        per_text = seg.segment_sums(lengths, offsets)
        empty = n_bytes == 0
        begins, ends = np.maximum(all_begins + within, 0).astype(np.int32), np.maximum(all_ends + within, 0).astype(np.int32)
        if empty.any():  # the blank put in front is no text
            keep = np.repeat(~empty, per_text)
            all_ids, begins, ends = all_ids[keep], begins[keep], ends[keep]
            per_text = np.where(empty, 0, per_text)
        return np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64), all_ids, begins, ends

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        decode = self.library.decode
        return [decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


#: What the operator returns for each text.
RESULTS = pa.schema([("ids", pa.large_list(pa.int32())), ("begins", pa.large_list(pa.int32())), ("ends", pa.large_list(pa.int32())), ("decoded", pa.large_string())])
RESULT_DDL = "ids array<int>, begins array<int>, ends array<int>, decoded string"


def encode_pieces(
    docs: DataFrame,
    model_path: str,
    *,
    text_col: str = "text",
    keep: list[str] | None = None,
    derive: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    derived: str | None = None,
    batch_bytes: int = seg.BATCH_BYTES,
) -> DataFrame:
    """`keep` columns with ids, begins, ends (byte spans in the original UTF-8 text) and decoded.

    `derive` maps an Arrow batch of those four results to other columns (`derived`,
    as DDL) in the same pass, so that long lists need not leave the worker.
    Map-only; memory is bounded by `batch_bytes` and the longest text.
    """
    out = T.StructType.fromDDL(derived if derive else RESULT_DDL)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in out.names]
    schema = T.StructType([*(docs.schema[c] for c in keep), *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        seg.take_over("pieces")
        for batch in seg.byte_balanced(batches, text_col, batch_bytes):
            texts = seg.large_text(batch.column(text_col))
            offsets, *lists = m.encode(texts)
            made = [pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in lists]
            results = pa.RecordBatch.from_arrays([*made, pa.array(m.decode(offsets, lists[0]), pa.large_string())], schema=RESULTS)
            if derive:
                results = derive(results)
            else:
                results = pa.RecordBatch.from_arrays([c.cast(pa.list_(pa.int32())) if pa.types.is_large_list(c.type) else c.cast(pa.string()) for c in results.columns], results.schema.names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *results.columns], [*keep, *results.schema.names])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the library's decoding of a column of ids (null: null)."""
    schema = T.StructType([*(f for f in encoded.schema if f.name != out_col), T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = model(model_path).library.decode
        for batch in batches:
            texts = [None if ids is None else decode(ids) if ids else "" for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:-1]), pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)
