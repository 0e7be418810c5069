"""N-gram Jaccard self-join of documents by MinHash banding.

1. Every text becomes a signature of `bands` x `rows` minima over its word
   n-grams; band and row counts follow from the target recall at the threshold.
   Texts with the same words in the same order are one class of copies, which
   goes on as its smallest doc_id.
2. Class representatives are shuffled on (band, hash); each bucket hangs its
   members on its smallest, which makes a candidate graph without listing pairs.
3. Connected parts of that graph are cut into blocks by hash; every pair of blocks
   of a part is one unit of work of bounded rows and bytes, in which all pairs
   are verified on full n-gram sets by matrix products. A unit returns one row a
   document: links found, and the smallest document it is tied to.
4. Components of the verified ties are the classes.

Words are as in `wordhash.py`. A text with fewer than n words is one n-gram of
all its words; texts without words are alike only if their bytes are equal
(null: empty). Rows with a null doc_id take part in nothing and are not returned.
Rows that repeat a doc_id with the same text count once; with different texts
the doc_id gets the smallest of its classes and the sum of links. Of equally small
members a bucket hangs on the smallest doc_id. Texts of any length count whole, and
other columns, whatever their names, are not read. An empty table gives no rows.

Every pair of a candidate part is verified, which counts every link exactly; the
work in a part of m different texts is m * m / 2 comparisons, and each text is
sent once for each of the part's blocks (m / 2048 of them for a large one).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments as seg
from . import wordhash as wh
from .components import components, splittable
from .storage import materialise, scratch

#: Rows of a block of a small part, most blocks before blocks grow, rows and bytes of a block at most.
BLOCK_ROWS, FEW_BLOCKS, MOST_ROWS, MOST_BYTES = 128, 16, 2_048, 16 << 20
#: N-grams hashed by all functions while they stay in the processor's cache.
CHUNK = 1 << 15


def bands_for(threshold: float, recall: float, *, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, with the fewest bands, that reach `recall` at `threshold` within `most` minima."""
    best = (most, 1)
    for rows in range(1, 17):
        hit = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - hit)) if hit < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, wh.Words]:
    """N-gram hashes and offsets (with repeats), two sequence hashes a text, and the words."""
    w = wh.words(texts)
    counts = np.diff(w.offsets)
    place = np.arange(len(w.hashes)) - np.repeat(w.offsets[:-1], counts)
    up, _ = wh.powers(int(counts.max()) + 1 if len(counts) else 1)
    weighted = w.hashes * up[place] if len(w.hashes) else w.hashes
    first = sums(weighted, w.offsets) + counts.astype(np.uint64)
    second = sums(wh.mix(weighted ^ wh.mix(place.astype(np.uint64))), w.offsets)
    blank = np.flatnonzero(counts == 0)
    for i in blank.tolist():
        raw = texts[i].as_py().encode()
        data = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        up_raw, down_raw = wh.powers(len(raw) + 1)
        first[i], second[i] = wh.mix((data * up_raw[: len(raw)]).sum(keepdims=True, dtype=np.uint64))[0], (data * down_raw[: len(raw)]).sum(dtype=np.uint64)
    grams, offsets = wh.ngrams(w, n)
    few = (counts > 0) & (counts < n)
    if few.any():
        sizes = np.diff(offsets) + few
        new_offsets = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(new_offsets[-1]), np.uint64)
        own = np.zeros(len(out), bool)
        own[new_offsets[:-1][few]] = True
        out[own], out[~own] = wh.mix(first[few]), grams
        grams, offsets = out, new_offsets
    return grams, offsets, wh.mix(first), second, w


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def signatures(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, texts x bands; rows of texts without n-grams are arbitrary."""
    rng = np.random.default_rng(20240607)
    factors = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    n = len(offsets) - 1
    out = np.full((bands * rows, n), 0xFFFFFFFF, np.uint32)
    small = (grams >> np.uint64(32)).astype(np.uint32)
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes > 0)
    at = 0
    while at < len(full):
        stop = max(at + 1, int(np.searchsorted(offsets[full], offsets[full[at]] + CHUNK)))
        own = full[at:stop]
        x = small[offsets[own[0]] : offsets[own[-1] + 1]]
        starts = offsets[own] - offsets[own[0]]
        for k in range(bands * rows):
            y = x * factors[k] + shifts[k]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[k, own] = np.minimum.reduceat(y, starts)
        at = stop
    hashes = np.empty((n, bands), np.uint64)
    for b in range(bands):
        h = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            h = wh.mix(h * np.uint64(wh.BASE) + out[b * rows + r])
        hashes[:, b] = h
    return hashes


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text hash, bytes, sequence hashes, and band hashes ([] for texts without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg.take_over("minhash")
        for batch in seg.byte_balanced(batches, "text"):
            texts = seg.large_text(batch.column("text"))
            grams, offsets, first, second, w = ngram_sets(texts, n)
            hashes = signatures(grams, offsets, bands, rows).view(np.int64)
            has = np.diff(w.offsets) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)), pa.array(hashes[has].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pc.binary_length(texts).cast(pa.int64()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), lists], ["doc_id", "th", "n_bytes", "s1", "s2", "bands"])

    return docs.mapInArrow(run, "doc_id long, th long, n_bytes long, s1 long, s2 long, bands array<long>")


def verify_units(threshold: float, n: int):
    """Arrow function over rows sorted by unit (part, i, j): links and ties of each document."""

    def unit(rows: list[dict], i: int, j: int) -> Iterator[tuple[int, int, int]]:
        known = {(r["node"], r["th"]): r for r in rows}  # repeats of a row are one document
        own = [known[k] for k in sorted(known)]
        ids, copies = [r["node"] for r in own], np.array([r["copies"] for r in own], np.int64)
        m = len(own)
        grams, offsets, *_ = ngram_sets(pa.array([r["text"] or "" for r in own], pa.large_string()), n)
        owner = np.repeat(np.arange(m), np.diff(offsets))
        values, inverse = np.unique(grams, return_inverse=True)
        pairs = np.unique(inverse.astype(np.int64) * m + owner)  # n-grams x documents, once each
        gram, owner = pairs // m, pairs % m
        size = np.bincount(owner, minlength=m)
        shared = np.bincount(gram, minlength=len(values))[gram] > 1
        gram, owner = gram[shared], owner[shared]
        gram = np.unique(gram, return_inverse=True)[1]
        width = int(gram.max()) + 1 if len(gram) else 0
        side = np.array([r["own"] for r in own])
        left, right = (np.arange(m), np.arange(m)) if i == j else (np.flatnonzero(side == i), np.flatnonzero(side == j))
        common = np.zeros((len(left), len(right)), np.float32)
        step = max(1, (8 << 20) // max(m, 1))
        for k in range(0, width, step):
            here = (gram >= k) & (gram < k + step)
            part = np.zeros((m, min(step, width - k)), np.float32)
            part[owner[here], gram[here] - k] = 1
            common += part[left] @ part[right].T
        common = common.astype(np.int64)
        either = size[left][:, None] + size[right][None, :] - common
        tied = (common >= threshold * either - 1e-9) & (either > 0)
        if i == j:
            np.fill_diagonal(tied, False)
        links = np.zeros(m, np.int64)
        links[left] += tied @ copies[right]
        if i != j:
            links[right] += tied.T @ copies[left]
        at, to = np.nonzero(tied)
        at, to = left[at], right[to]
        root = np.arange(m)  # documents stand in the order of their ids
        while True:
            lower = root.copy()
            np.minimum.at(lower, at, root[to])
            np.minimum.at(lower, to, root[at])
            lower = np.minimum(lower, lower[lower])
            if (lower == root).all():
                break
            root = lower
        for a in np.flatnonzero(links).tolist():
            yield ids[a], int(links[a]), ids[root[a]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg.take_over("minhash")
        held: list[dict] = []
        out: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["node", "links", "root"])
            out.clear()
            return batch

        key = None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["i"], row["j"]) != key:
                    if len(held) > 1:
                        out.extend(unit(held, key[1], key[2]))
                    held, key = [], (row["part"], row["i"], row["j"])
                    if len(out) > 10_000:
                        yield flush()
                held.append(row)
        if len(held) > 1:
            out.extend(unit(held, key[1], key[2]))
        if out:
            yield flush()

    return run


def near_duplicates(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.9998, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_links (documents it is similar to), n_copies (of its own words).

    The result is a written table; all others are deleted.
    """
    with scratch(docs.sparkSession):
        return materialise(joined(docs, n, threshold, recall, id_col, text_col), "near", last=True)


def joined(docs: DataFrame, n: int, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """The join of `near_duplicates`, step by step."""
    bands, rows = bands_for(threshold, recall)
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signed = materialise(sign(base, n, bands, rows), "signatures")
    members = signed.select("doc_id", "s1", "s2")
    # repeats of one (doc_id, text) count once
    classes = signed.groupBy("s1", "s2", "bands", "doc_id").agg(F.min("th").alias("th"), F.max("n_bytes").alias("n_bytes")).groupBy("s1", "s2", "bands").agg(F.min("doc_id").alias("node"), F.min_by("th", "doc_id").alias("th"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"))
    classes = materialise(classes.select("s1", "s2", "bands", "node", "th", "copies", "n_bytes"), "classes")
    spread = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = spread.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1")
    buckets = splittable(buckets, "hash")
    edges = spread.join(buckets, ["band", "hash"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    parts = components(edges)
    verified = materialise(verified_ties(base, classes, parts, threshold, n), "ties")
    found = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = classes.select("s1", "s2", "node", "copies").join(links, "node", "left").join(found, "node", "left")
    nodes = nodes.select("s1", "s2", "copies", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.distinct().join(nodes, ["s1", "s2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").cast("long").alias("n_links"), F.max("copies").cast("long").alias("n_copies"))


def verified_ties(base: DataFrame, classes: DataFrame, parts: DataFrame, threshold: float, n: int) -> DataFrame:
    """node, links (weighted by copies), root for each unit's linked documents."""
    sized = parts.join(classes.select("node", "th", "copies", "n_bytes"), "node")
    weight = sized.groupBy("root").agg(F.count("*").alias("m"), F.sum("n_bytes").alias("bytes"))
    blocks = F.greatest(F.least(F.ceil(F.col("m") / BLOCK_ROWS), F.lit(FEW_BLOCKS)), F.ceil(F.col("m") / MOST_ROWS), F.ceil(F.col("bytes") / MOST_BYTES)).cast("int")
    weight = weight.select("root", blocks.alias("blocks"))
    placed = sized.join(weight, "root").select(F.col("root").alias("part"), "node", "th", "copies", "blocks", F.pmod(F.xxhash64("node", "th"), F.col("blocks")).cast("int").alias("own"))
    texts = base.join(placed, (base["doc_id"] == placed["node"]) & (base["th"] == placed["th"])).select(placed["part"], placed["node"], placed["th"], placed["copies"], placed["blocks"], placed["own"], base["text"])
    units = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("part", "node", "th", "copies", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "text")
    return units.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "node").mapInArrow(verify_units(threshold, n), "node long, links long, root long")
