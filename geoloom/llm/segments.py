"""Encoding of whole texts through distinct, independent segments.

A tokenizer whose tokens never reach across certain places in a text gives the
same ids for the text as for the pieces between those places, one after the
other. Batches of texts are therefore cut into segments in Arrow kernels, the
distinct segments of a batch are encoded once by the library itself, and the
results are spread back with array indexing. Segments seen in earlier batches
come from a cache bounded by its bytes. Texts for which the cut is not proven safe go to the
library whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a batch closes when it reaches this.
BATCH_BYTES = 2 << 20
#: Bytes that a cache of segments may take in one Python worker, and the longest segment it keeps.
CACHE_BYTES, LONGEST_KEPT = 96 << 20, 256
#: Bytes of a cached entry beside those of its text and result: two objects and a place in the table.
ENTRY_BYTES = 240
#: Marks a cut; a text that holds it is encoded whole. Others that may take its place.
MARK = "\x1f"
MARKS = (MARK, "\x1e", "\x1d", "\x1c", "\x01", "\x02", "\ue000", "\ufdd0")


def large_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls (null: empty) and without an offset.

    The copy matters: some kernels of this Arrow version misread slices.
    """
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts))))


def byte_balanced(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Regroup batches so that each holds about `limit` bytes of text.

    A row with more than `limit` bytes stands alone; small batches are joined.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = int(np.searchsorted(ends, before + limit - size, side="right"))
            if upto <= at and not held:
                upto = at + 1
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1] - before)
                at = upto
            if at < batch.num_rows or size >= limit:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    columns = [pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)]
    return pa.RecordBatch.from_arrays(columns, schema=batches[0].schema)


def free_mark(texts: pa.Array) -> str | None:
    """A mark that none of the texts holds."""
    return next((m for m in MARKS if not pc.any(pc.match_substring(texts, m)).as_py()), None)


def cut(texts: pa.Array, before: str, *, more_space: str = "", mark: str = MARK) -> tuple[np.ndarray, pa.Array]:
    """Cut each text before every character of class `before` that follows a non-space.

    `more_space` is a class of characters that are space besides the usual ones.
    Returns list offsets and the flat segments; concatenating the segments of a
    text gives the text.
    """
    marked = pc.replace_substring_regex(texts, rf"([^ \t\n\f\r\v{more_space}])([{before}])", rf"\1{mark}\2")
    lists = pc.split_pattern(marked, mark)
    return lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten()


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Cut each text at blanks and line feeds, which are left out."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    return lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten()


def ragged_take(offsets: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the ragged rows `index`; returns (lengths, values)."""
    lengths = np.diff(offsets)[index]
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    at = np.arange(total, dtype=np.int64) + np.repeat(offsets[:-1][index] - (ends - lengths), lengths)
    return lengths, values[at]


def segment_sums(per_segment: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `per_segment` over each list of segments."""
    total = np.concatenate([[0], np.cumsum(per_segment)])
    return total[offsets[1:]] - total[offsets[:-1]]


_CACHES: list[SegmentCache] = []
_OWNER: list[str] = []


def take_over(owner: str) -> None:
    """Forget what other operators have cached in this worker."""
    if _OWNER != [owner]:
        _OWNER[:] = [owner]
        for cache in _CACHES:
            cache.young, cache.old, cache.held = {}, {}, 0


class SegmentCache:
    """Results by segment in two generations: when the young one is full it becomes the old one.

    `bound` is in bytes, by an estimate, and holds for both together; segments of
    more than `LONGEST_KEPT` characters are encoded and not kept.
    """

    def __init__(self, encode, bound: int = CACHE_BYTES):
        self.encode, self.bound = encode, bound // 2
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.held = 0
        _CACHES.append(self)

    def keep(self, segment: str, result) -> None:
        """Remember a result, in a new generation if the young one is full."""
        cost = ENTRY_BYTES + len(segment) * (1 if segment.isascii() else 4) + (len(result) if isinstance(result, bytes) else 0)
        if len(segment) > LONGEST_KEPT or cost > self.bound:
            return
        if self.held + cost > self.bound:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[segment] = result
        self.held += cost

    def __call__(self, segments: list[str]) -> list:
        young, old = self.young, self.old
        out = [young.get(s) for s in segments]
        new = []
        for k, found in enumerate(out):
            if found is None:
                segment = segments[k]
                found = out[k] = old.get(segment)
                if found is None:
                    new.append(k)
                else:
                    self.keep(segment, found)
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            for k, result in zip(part, self.encode([segments[k] for k in part]), strict=True):
                out[k] = result
                self.keep(segments[k], result)
        return out


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers, the form in which caches keep them."""
    return array("i", ids).tobytes()


def unpacked(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of packed lists laid end to end."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
    return np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(parts), np.int32)
