"""Contiguous minimax partition of documents into shards, in DataFrame operations.

Documents with equal texts are one group that no cut divides. Groups are ordered
by the digest of their text; the partition is the one into at most `shards`
runs of that order whose largest run is smallest. Its capacity is found by
binary search, each step checking greedily how far every shard reaches.

The order is a digest, so a prefix of it names ranges of nearly equal weight:
running sums need no global sort, only a window within each range and one over
the ranges, whose number follows the number of groups. The greedy check needs sums at the cuts alone: the driver
holds a table of bounded size (`RESOLUTION` intervals of the running sum), bounds
the capacity with it, and refines only intervals where a cut of a capacity still
possible may fall, until those hold single groups.

Size of a document: UTF-8 bytes of its text plus `overhead`; null counts as an
empty text. Rows that repeat a doc_id, or have none, stay separate; within a
group slots go by part, doc_id (null first) and row. Very long texts count whole.
Other columns, whatever their names, are not read. A group larger than every
capacity but its own gets a shard of its own size; with fewer groups than shards
the last shards stay empty. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, scratch

#: Groups in a range of the digest order, rows in a part of a group, about; intervals the driver holds at once.
RANGE_GROUPS, PART_ROWS, RESOLUTION = 100_000, 250_000, 20_000


def digits_for(rows: int) -> int:
    """Hexadecimal digits that name a range: 4096 ranges, and 16 or 256 times as many for very many rows."""
    return next((d for d in (3, 4) if 16**d * RANGE_GROUPS >= rows), 5)


def bucket(digits: int) -> Column:
    return F.conv(F.substring("digest", 1, digits), 16, 10).cast("int")


def running(groups: DataFrame, digits: int) -> DataFrame:
    """digest, size, rows, and `upto`: sizes of this group and all before it."""
    groups = groups.withColumn("bucket", bucket(digits))
    totals = groups.groupBy("bucket").agg(F.sum("size").alias("b_size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a range, 16^5 at most
    totals = totals.select("bucket", F.coalesce(F.sum("b_size").over(before), F.lit(0)).alias("size_before"))
    inside = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    return groups.join(totals, "bucket").select("digest", "size", "rows", (F.sum("size").over(inside) + F.col("size_before")).alias("upto"))


class Reach:
    """What is known of the running sums: exact values in refined stretches, interval ends elsewhere.

    `ends` are known running sums in rising order; `whole[k]` says that no group ends
    strictly between ends[k-1] and ends[k].
    """

    def __init__(self, ends: list[int], whole: list[bool]):
        self.ends, self.whole = ends, whole

    def furthest(self, limit: int) -> tuple[int, int]:
        """Bounds of the largest running sum that is at most `limit`."""
        k = bisect_left(self.ends, limit + 1)
        low = self.ends[k - 1] if k else 0
        if k == len(self.ends) or self.whole[k]:
            return low, low
        return low, min(limit, self.ends[k] - 1)

    def nearest_above(self, limit: int) -> tuple[int, int]:
        """Bounds of the smallest running sum that is at least `limit`."""
        k = bisect_left(self.ends, limit)
        before = self.ends[k - 1] if k else 0
        return (self.ends[k], self.ends[k]) if self.whole[k] else (max(limit, before + 1), self.ends[k])

    def fits(self, capacity: int, shards: int, hopeful: bool) -> bool:
        """Whether greedy filling ends within `shards`, with upper or lower bounds of each reach."""
        at = 0
        for _ in range(shards):
            at = self.furthest(at + capacity)[hopeful]
            if at >= self.ends[-1]:
                return True
        return False

    def unknown(self, low: int, high: int) -> list[tuple[int, int]]:
        """Stretches (from, to] with running sums that are not known between two bounds."""
        a, b = bisect_left(self.ends, low), bisect_left(self.ends, high)
        return [(self.ends[k - 1] if k else 0, self.ends[k] - 1) for k in range(a, min(b, len(self.ends) - 1) + 1) if not self.whole[k]]

    def levelled(self, capacity: int, shards: int) -> tuple[list[int], list[tuple[int, int]]]:
        """(cuts, stretches that have to be known before the cuts are right)."""
        total, missing = self.ends[-1], []

        def exactly(bounds: tuple[int, int]) -> int:
            if bounds[0] != bounds[1]:
                missing.extend(self.unknown(*bounds))
            return bounds[1]

        least_ends = [total]  # from where the shards after can hold the rest
        for _ in range(shards - 1):
            least_ends.append(exactly(self.nearest_above(max(least_ends[-1] - capacity, 1))) if least_ends[-1] > capacity else 0)
        cuts, at = [], 0
        for left, floor in zip(range(shards, 0, -1), reversed(least_ends), strict=True):
            aim = min(max(at - (at - total) // left, floor), at + capacity)  # an even share, rounded up
            low, high = exactly(self.furthest(aim)), exactly(self.nearest_above(min(aim + 1, total)))
            low_stands, high_stands = low > at and low >= floor, high <= at + capacity
            at = high if high_stands and (not low_stands or high - aim < aim - low) else low
            cuts.append(at)
            if at >= total:
                break
        return cuts, missing


def least(low: int, high: int, good) -> int:
    """Smallest value of low..high that is good; high is known to be."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if good(middle) else (middle + 1, high)
    return low


def minimax_cuts(sums: DataFrame, shards: int, *, resolution: int = RESOLUTION) -> tuple[int, list[int]]:
    """(capacity, running sum at the end of each shard) of the best partition.

    `sums` has one row a group with size and upto. The driver collects at most
    about `resolution` intervals in each of a few rounds.
    """
    top = sums.agg(F.max("upto").alias("total"), F.max("size").alias("largest")).first()
    if top is None or top["total"] is None:
        return 0, []
    total, largest = int(top["total"]), int(top["largest"])
    known: dict[int, bool] = {total: False}

    def look(stretches: list[tuple[int, int]]) -> Reach:
        """List what ends in the stretches (from, to], interval by interval."""
        width = max(1, -(-sum(b - a for a, b in stretches) // resolution))
        which, k = F.lit(None).cast("int"), F.lit(None).cast("long")
        for n, (a, b) in enumerate(stretches):
            here = (F.col("upto") > a) & (F.col("upto") <= b)
            which, k = F.when(here, n).otherwise(which), F.when(here, F.floor((F.col("upto") - a - 1) / width).cast("long")).otherwise(k)
        found = sums.select(which.alias("s"), k.alias("k"), "upto").where("s is not null").groupBy("s", "k").agg(F.min("upto").alias("lo"), F.max("upto").alias("hi"), F.count("*").alias("n")).collect()
        for _, b in stretches:
            if b + 1 in known:
                known[b + 1] = True  # what ends before it is listed now
        for r in found:
            known[int(r["lo"])] = True  # nothing ends between the interval before and its first group
            if r["n"] > 1:
                known[int(r["hi"])] = r["n"] == 2
        ends = sorted(k for k in known if k > 0)
        return Reach(ends, [known[k] for k in ends])

    stretches = [(0, total)]
    low, high = max(largest, -(-total // shards)), total
    while stretches:
        reach = look(stretches)
        high = least(low, high, lambda c: reach.fits(c, shards, False))
        low = least(low, high, lambda c: reach.fits(c, shards, True))
        open_ends: list[tuple[int, int]] = []
        at_low = at_high = 0
        for _ in range(shards):  # where the cuts of capacities low..high may fall
            first, last = reach.furthest(at_low + low), reach.furthest(at_high + high)
            open_ends += reach.unknown(first[0], last[1])
            at_low, at_high = first[0], last[1]
        stretches = [s for s in sorted(set(open_ends)) if s[1] > s[0]]
    while True:
        cuts, missing = reach.levelled(high, shards)
        missing = [s for s in sorted(set(missing)) if s[1] > s[0]]
        if not missing:
            return high, cuts
        reach = look(missing)


def assign_shards(docs: DataFrame, shards: int, *, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text", resolution: int = RESOLUTION) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null).

    Three shuffles of narrow rows (id, size, digest); texts are read once and never
    move. The result is a written table; all others are deleted.
    """
    with scratch(docs.sparkSession):
        return materialise(placed_documents(docs, shards, overhead, id_col, text_col, resolution), "shards", last=True)


def placed_documents(docs: DataFrame, shards: int, overhead: int, id_col: str, text_col: str, resolution: int) -> DataFrame:
    """The partition of `assign_shards`, step by step."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "sizes")
    total = rows.count()
    digits = digits_for(total)
    # documents in parts of a group; a part's rows are numbered by a window, parts by counts
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("row"))), F.lit(max(64, -(-total // PART_ROWS)))).cast("int"))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    sums = materialise(running(groups, digits), "sums")
    _, cuts = minimax_cuts(sums, shards, resolution=resolution)
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + (F.col("upto") > cut).cast("int")
    placed = sums.select("digest", "rows", shard.alias("shard"), bucket(digits).alias("bucket"))
    # groups before this one in the shard, then parts before this one in the group
    per_range = placed.groupBy("bucket", "shard").agg(F.sum("rows").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("bucket", "shard").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("in_range", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(per_range, ["bucket", "shard"])
    placed = placed.select("digest", "shard", (F.col("range_start") + F.col("in_range")).alias("group_start"))
    parts = rows.groupBy("digest", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = parts.withColumn("part_start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(placed, "digest").select("digest", "part", "shard", (F.col("group_start") + F.col("part_start")).alias("start"))
    number = Window.partitionBy("digest", "part").orderBy("doc_id", "row")
    numbered = rows.withColumn("number", F.row_number().over(number) - 1)
    return numbered.join(parts, ["digest", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
