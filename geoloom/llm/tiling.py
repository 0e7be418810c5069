"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (as in `wordhash.py`).
Seeds are hashes of `min_match` words in a row; a document meets an item where
they share a seed. For each such pair, running Karp-Rabin finds the longest
common runs of words not marked yet, marks all of that length that do not
overlap, and goes on until none of `min_match` words is left. The share of the
item's words that is marked is its coverage; passages in another order are
covered all the same. A document is contaminated if an item's coverage reaches
the threshold.

A benchmark of at most `block_bytes` of text (measured first) is known to every
worker, and one pass over the documents joins and tiles. A larger one stays
distributed: seeds of documents and items are joined by shuffles, and only texts
that may reach the threshold meet their items, one pair at a time. Both give the
same rows. In the latter an item meets documents by its rarest seeds only: its most
frequent ones are left aside as long as their places cover less of it than the
threshold, since a document that shares no other cannot reach it. A stock phrase
of many documents and items so makes no pairs.

Null or empty texts and items match nothing; items with fewer than `min_match`
words have no seeds of that length and are looked for as a whole. Repeated rows
give repeated results; an item that repeats counts once by its item_id and text.
Ties between runs of one length go to the earlier place in the document, then in
the item. Very long and repetitive texts cost time in proportion to their words
for each search length. Documents' columns in `keep` whose names clash with
results are replaced. An empty table gives no rows; an empty benchmark
contaminates nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import segments as seg
from . import wordhash as wh
from .components import splittable
from .storage import materialise

#: Bytes of item texts that every worker may hold.
BLOCK_BYTES = 32 << 20
ITEM_DDL = "item_id long, coverage double, words long"
RESULT_DDL = f"items array<struct<{ITEM_DDL.replace(' ', ': ').replace(',:', ',')}>>, n_items long, max_coverage double, contaminated boolean"
ITEM_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("words", pa.int64())]))


@dataclass
class Seeds:
    """Items whose seeds have one length: their words, and each distinct seed with the items that hold it."""

    ids: list
    words: list[np.ndarray]
    hashes: np.ndarray  #: sorted; a row for each seed and item
    item: np.ndarray
    places: np.ndarray  #: how often the seed stands in the item
    size: int  #: words in a seed


def build_seeds(items: list[tuple], min_match: int) -> list[Seeds]:
    """Seeds of items (id, text), grouped by seed length (short items have their own)."""
    w = wh.words(pa.array([t or "" for _, t in items], pa.large_string()))
    words = [w.hashes[a:b] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
    by_size: dict[int, list[int]] = defaultdict(list)
    for k, own in enumerate(words):
        if len(own):
            by_size[min(len(own), min_match)].append(k)
    out = []
    for size, members in sorted(by_size.items()):
        own = [np.unique(run_hashes(words[k], size), return_counts=True) for k in members]
        hashes = np.concatenate([h for h, _ in own])
        order = np.argsort(hashes, kind="stable")
        item = np.repeat(np.arange(len(members)), [len(h) for h, _ in own])
        out.append(Seeds([items[k][0] for k in members], [words[k] for k in members], hashes[order], item[order], np.concatenate([n for _, n in own])[order], size))
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row, as `wordhash.ngrams` makes them."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    gram = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        gram = wh.mix(gram * np.uint64(wh.BASE) + words[k : len(words) - n + 1 + k])
    return gram


class Running:
    """One side of a pair: its words, which of them are free, and running sums for window hashes."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.words, self.free = words, free.copy()
        up, self.down = wh.powers(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all free windows of n words, and their Karp-Rabin hashes."""
        if n > len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[n:] == taken[: len(taken) - n])
        return at, (self.sums[at + n] - self.sums[at]) * self.down[at]


def common(a: Running, b: Running, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Free windows of n words that both sides have: places and hashes in a, then in b."""
    (pa_, ha), (pb, hb) = a.windows(n), b.windows(n)
    in_a, in_b = np.isin(ha, hb), np.isin(hb, ha)
    return pa_[in_a], ha[in_a], pb[in_b], hb[in_b]


def tile(doc: np.ndarray, item: np.ndarray, min_match: int, doc_free: np.ndarray | None = None, item_free: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (place in document, place in item, words) of a pair of word-hash sequences.

    Every round searches for the longest length at which free windows of both
    sides agree: lengths double until one fails, then halve the gap, and no later
    round looks at longer ones. Windows of the item of that
    length stand in a table by hash; the document's are looked up from left to
    right, and those still free are marked.
    """
    every = lambda x, free: np.ones(len(x), bool) if free is None else free
    a, b = Running(doc, every(doc, doc_free)), Running(item, every(item, item_free))
    tiles: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item)) + 1  # no common run is as long
    while most > min_match:
        low, high, n, found = min_match - 1, most, min_match, None
        while high - low > 1:
            here = common(a, b, n)
            if len(here[0]):
                low, found = n, here
            else:
                high = n
            n = min(2 * n, high - 1) if high == most else (low + high) // 2  # short runs are the usual case
        if found is None:
            break
        mark(a, b, low, found, tiles)
        most = low
    return tiles


def mark(a: Running, b: Running, n: int, found: tuple, tiles: list[tuple[int, int, int]]) -> None:
    """Marks all windows of n words that agree, from left to right, each item window once."""
    places, hashes, item_places, item_hashes = found
    table: dict[int, list[int]] = defaultdict(list)
    for p, h in zip(item_places[::-1].tolist(), item_hashes[::-1].tolist(), strict=True):
        table[h].append(p)  # the earliest place last
    end = -1
    for d, h in zip(places.tolist(), hashes.tolist(), strict=True):
        waiting = table[h]
        while d >= end and waiting:  # a place that is not free now never will be
            p = waiting.pop()
            if b.free[p : p + n].all() and np.array_equal(a.words[d : d + n], b.words[p : p + n]):
                a.free[d : d + n] = False
                b.free[p : p + n] = False
                tiles.append((d, p, n))
                end = d + n


def seeded(words: np.ndarray, grams: np.ndarray, shared: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a seed of `shared` (sorted); no tiling marks another."""
    free = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(grams, shared))
    np.add.at(free, at, 1)
    np.add.at(free, at + size, -1)
    return np.cumsum(free[:-1]) > 0


def covered(doc: np.ndarray, item: np.ndarray, size: int, threshold: float) -> int:
    """Words of the item that the tiling of a pair marks; 0 if they can't reach the threshold."""
    doc_grams, item_grams = run_hashes(doc, size), run_hashes(item, size)
    shared = np.intersect1d(doc_grams, item_grams)
    item_free = seeded(item, item_grams, shared, size)
    if item_free.sum() < threshold * len(item):
        return 0
    doc_free = seeded(doc, doc_grams, shared, size)
    kept = np.flatnonzero(doc_free)  # the stretches of the document that matter, a marked word between them
    cuts = np.flatnonzero(np.diff(kept) > 1) + 1
    doc = np.insert(doc[kept], cuts, np.uint64(0))
    doc_free = np.insert(np.ones(len(kept), bool), cuts, False)
    return sum(n for *_, n in tile(doc, item, size, doc_free, item_free))


def matches(w: wh.Words, blocks: list[Seeds], threshold: float) -> dict[int, list[tuple]]:
    """By text: (item id, coverage, words marked) of items at or above the threshold."""
    out: dict[int, list[tuple]] = defaultdict(list)
    for seeds in blocks:
        grams, offsets = wh.ngrams(w, seeds.size)
        if not len(grams) or not len(seeds.hashes):
            continue
        place = np.searchsorted(seeds.hashes, grams)
        hit = np.flatnonzero(seeds.hashes[np.minimum(place, len(seeds.hashes) - 1)] == grams)
        if not len(hit):
            continue
        text_of = np.searchsorted(offsets, hit, side="right") - 1
        first = np.unique(np.stack([text_of.astype(np.uint64), grams[hit]], 1), axis=0)  # a seed counts once in a text
        lengths = np.array([len(x) for x in seeds.words])
        low, high = np.searchsorted(seeds.hashes, first[:, 1]), np.searchsorted(seeds.hashes, first[:, 1], side="right")
        at = spans(low, high)
        pair = np.repeat(first[:, 0].astype(np.int64), high - low) * len(lengths) + seeds.item[at]
        pairs, number = np.unique(pair, return_inverse=True)
        reach = np.bincount(number, seeds.places[at] * seeds.size)  # words that these seeds cover at most
        for p in pairs[reach >= threshold * lengths[pairs % len(lengths)]].tolist():
            text, m = divmod(p, len(lengths))
            item = seeds.words[m]
            marked = covered(w.hashes[w.offsets[text] : w.offsets[text + 1]], item, seeds.size, threshold)
            if marked and marked >= threshold * len(item):
                out[text].append((seeds.ids[m], marked / len(item), marked))
    return out


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of the ranges low..high-1, one range after the other."""
    counts = high - low
    return np.arange(int(counts.sum())) + np.repeat(low - np.cumsum(counts) + counts, counts)


def verdict(items: list[list[dict]], threshold: float) -> list[pa.Array]:
    """The result columns for each text's list of items."""
    best = [max((x["coverage"] for x in y), default=0.0) for y in items]
    return [pa.array(items, ITEM_TYPE), pa.array([len({x["item_id"] for x in y}) for y in items], pa.int64()), pa.array(best, pa.float64()), pa.array([x >= threshold and bool(y) for x, y in zip(best, items, strict=True)], pa.bool_())]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 4, threshold: float = 0.5, text_col: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`keep` columns with items (item_id, coverage, words), n_items, max_coverage and contaminated.

    Map-only if the benchmark's texts have at most `block_bytes` bytes.
    """
    made = T.StructType.fromDDL(RESULT_DDL)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in made.names]
    wanted = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    if size > block_bytes:
        return through_joins(docs, wanted, min_match, threshold, text_col, keep, made)
    rows = sorted(((r["i"], r["t"]) for r in wanted.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    shared = docs.sparkSession.sparkContext.broadcast(build_seeds(rows, min_match) if rows else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg.take_over("tiling")
        for batch in seg.byte_balanced(batches, text_col):
            found = matches(wh.words(seg.large_text(batch.column(text_col))), shared.value, threshold)
            items = [[{"item_id": i, "coverage": c, "words": n} for i, c, n in found.get(k, ())] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *verdict(items, threshold)], [*keep, *made.names])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *made.fields]))


def seeds_of(size_of: int | None):
    """Arrow function: (key, size, seed, places, words) of each text's seeds, a row a distinct seed.

    With `size_of` the seed length of a text is the smaller of that and its number
    of words (benchmark items); without it every length 1..`sizes` in the column is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seg.byte_balanced(batches, "t"):
            w = wh.words(seg.large_text(batch.column("t")))
            keys = batch.column("key").to_pylist()
            sizes = batch.column("sizes").to_pylist() if size_of is None else None
            out: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
            for k in range(len(keys)):
                own = w.hashes[w.offsets[k] : w.offsets[k + 1]]
                for n in sizes[k] if sizes else [min(len(own), size_of)]:
                    if 0 < n <= len(own):
                        out.append((k, n, len(own), *np.unique(run_hashes(own, n), return_counts=True)))
            if out:
                key, n, words, seeds, places = zip(*out, strict=True)
                m = [len(x) for x in seeds]
                spread = lambda x, t: pa.array(np.repeat(np.array(x, t), m))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()).take(spread(key, np.int64)), spread(n, np.int32), pa.array(np.concatenate(seeds).view(np.int64)), pa.array(np.concatenate(places).astype(np.int64)), spread(words, np.int64)], ["key", "size", "seed", "places", "words"])

    return run


def rarest(words: np.ndarray, size: int, seeds: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """Seeds (sorted, with their counts) of an item of which a text must have one to cover `threshold` of its words.

    Words that a text's tiling marks lie in shared seeds. So the most frequent seeds
    can be left aside until their places cover as much; ties go by the seed.
    """
    grams = run_hashes(words, size).view(np.int64)
    order = np.argsort(grams, kind="stable")
    first, last = (np.searchsorted(grams[order], seeds, side=s) for s in ("left", "right"))
    taken, covered_words = np.zeros(len(words), bool), 0
    queue = np.lexsort((seeds, -counts))
    for done, k in enumerate(queue):
        for place in order[first[k] : last[k]]:
            window = taken[place : place + size]
            covered_words += size - int(window.sum())
            window[:] = True
        if covered_words >= threshold * len(words):
            return np.sort(seeds[queue[done:]])
    return seeds[:0]


def rarest_seeds(threshold: float):
    """Arrow function: (key, size, seed) of the rarest seeds of items (key, t, size, found: seeds that texts have with their counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seg.byte_balanced(batches, "t"):
            w = wh.words(seg.large_text(batch.column("t")))
            keys, sizes, found = (batch.column(c).to_pylist() for c in ("key", "size", "found"))
            for k in range(batch.num_rows):
                seeds, counts = (np.array([x[c] for x in found[k]], np.int64) for c in ("seed", "n"))
                kept = rarest(w.hashes[w.offsets[k] : w.offsets[k + 1]], sizes[k], seeds, counts, threshold)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([pa.array([keys[k]] * len(kept), pa.string()), pa.array([sizes[k]] * len(kept), pa.int32()), pa.array(kept)], ["key", "size", "seed"])

    return run


def meeting_pairs(shared: DataFrame, item_seeds: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """text_key, item_key, size of pairs whose shared seeds may cover `threshold` of the item.

    `shared` has the texts' seeds that some item has (text_key, size, seed), once a
    text. Pairs come from the items' rarest seeds; only for those are all seeds counted.
    """
    counts = splittable(shared.groupBy("seed", "size").agg(F.count("*").alias("n")), "seed")
    held = item_seeds.join(counts, ["size", "seed"]).groupBy("key", "size").agg(F.array_sort(F.collect_list(F.struct("seed", "n"))).alias("found"))  # one item's seeds
    rare = items.select("key", "t").join(held, "key").select("key", "t", "size", "found").mapInArrow(rarest_seeds(threshold), "key string, size int, seed long")
    met = shared.join(rare.withColumnRenamed("key", "item_key"), ["size", "seed"]).select("text_key", "item_key", "size").distinct()
    every = item_seeds.withColumnRenamed("key", "item_key")
    reach = met.join(every, ["item_key", "size"]).join(shared, ["text_key", "size", "seed"]).groupBy("text_key", "item_key", "size").agg(F.sum("places").alias("n"), F.first("words").alias("words"))
    return reach.where(F.col("n") * F.col("size") >= F.col("words") * threshold).select("text_key", "item_key", "size")


SEED_DDL = "key string, size int, seed long, places long, words long"


def through_joins(docs: DataFrame, wanted: DataFrame, min_match: int, threshold: float, text_col: str, keep: list[str], made: T.StructType) -> DataFrame:
    """The same rows with the benchmark left distributed.

    Equal texts are one text by their SHA-256. Seeds meet by (length, hash) after
    each text's own are distinct; adaptive execution splits hot ones. Items meet
    texts by their rarest seeds, the words that shared seeds can cover are summed
    by (text, item) before any text moves, and each surviving pair is tiled by itself.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = materialise(wanted.select(F.concat_ws(":", F.coalesce(F.col("i").cast("string"), F.lit("")), F.sha2(F.col("t"), 256)).alias("key"), "i", "t"), "items")
    item_seeds = materialise(items.select("key", "t", F.lit(None).cast("array<int>").alias("sizes")).mapInArrow(seeds_of(min_match), SEED_DDL), "seeds")
    sizes = sorted(r["size"] for r in item_seeds.select("size").distinct().collect())  # at most min_match rows
    texts = docs.where(F.length(text_col) > 0).select(F.sha2(text, 256).alias("key"), text.alias("t")).dropDuplicates(["key"])
    doc_seeds = texts.withColumn("sizes", F.array(*map(F.lit, sizes)).cast("array<int>")).mapInArrow(seeds_of(None), SEED_DDL)
    known = splittable(item_seeds.select("seed", "size").distinct(), "seed")
    shared = materialise(doc_seeds.select(F.col("key").alias("text_key"), "size", "seed").join(known, ["size", "seed"], "left_semi"), "shared")
    pairs = materialise(meeting_pairs(shared, item_seeds, items, threshold), "pairs")
    met = pairs.join(items.select(F.col("key").alias("item_key"), "i", F.col("t").alias("item")), "item_key").join(texts.select(F.col("key").alias("text_key"), "t"), "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seg.byte_balanced(batches, "t"):
            a, b = (wh.words(seg.large_text(batch.column(c))) for c in ("t", "item"))
            keys, ids, n = (batch.column(c).to_pylist() for c in ("text_key", "i", "size"))
            out = []
            for k in range(batch.num_rows):
                item = b.hashes[b.offsets[k] : b.offsets[k + 1]]
                marked = covered(a.hashes[a.offsets[k] : a.offsets[k + 1]], item, n[k], threshold)
                if marked and marked >= threshold * len(item):
                    out.append((keys[k], {"item_id": ids[k], "coverage": marked / len(item), "words": marked}))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([x for _, x in out], ITEM_TYPE.value_type)], ["text_key", "hit"])

    hits = met.select("text_key", "i", "size", "item", "t").mapInArrow(run, f"text_key string, hit struct<{ITEM_DDL.replace(' ', ': ').replace(',:', ',')}>")
    found = hits.groupBy("text_key").agg(F.array_sort(F.collect_list("hit")).alias("items"))  # a row an item that the text holds
    rows = docs.select(*keep, F.sha2(text, 256).alias("_key")).join(splittable(found.withColumnRenamed("text_key", "_key"), "_key"), "_key", "left")
    items_col = F.coalesce("items", F.array().cast(made["items"].dataType))
    best = F.coalesce(F.array_max(F.transform(items_col, lambda x: x["coverage"])), F.lit(0.0))
    return rows.select(*keep, items_col.alias("items"), F.size(F.array_distinct(F.transform(items_col, lambda x: x["item_id"]))).cast("long").alias("n_items"), best.alias("max_coverage"), ((best >= threshold) & (F.size(items_col) > 0)).alias("contaminated"))
