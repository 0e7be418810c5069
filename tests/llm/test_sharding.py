import hashlib
import random
import zlib

import pytest

from geoloom.llm import sharding


def smallest_capacity(sizes, shards):
    def fits(c):
        used, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                used, at = used + 1, 0
            at += s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed,n,shards,resolution", [(1, 400, 24, 40), (2, 3, 24, 40), (3, 1000, 7, 30), (4, 200, 24, 20000), (5, 50, 5, 3)])
def test_capacity_is_minimal(spark, seed, n, shards, resolution):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 8, 9, rng.randint(1, 100), rng.randint(1, 5000)]) for _ in range(n)]
    if seed == 3:
        sizes[500] = sum(sizes) // 2
    rows, at = [], 0
    for s in sizes:
        at += s
        rows.append((s, at))
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(rows, "size long, upto long"), shards, resolution=resolution)
    assert capacity == smallest_capacity(sizes, shards)
    ends = {r[1] for r in rows}
    assert set(cuts) <= ends and cuts[-1] == at and len(cuts) == min(shards, n)
    loads = [b - a for a, b in zip([0, *cuts], cuts)]
    assert max(loads) <= capacity and min(loads) > 0
    levelled = 0
    for k in range(len(loads) - 1):  # each ends as near as can be to an even share of the rest, or where the rest needs it
        even = levelled + (at - levelled) / (shards - k)
        nearest = min((e for e in ends if e > levelled), key=lambda e: abs(e - even))
        fits_rest = smallest_capacity([r[0] for r in rows if r[1] > nearest], shards - k - 1) <= capacity
        assert cuts[k] == nearest or abs(abs(cuts[k] - even) - abs(nearest - even)) <= 1 or nearest > levelled + capacity or not fits_rest
        levelled = cuts[k]


def test_one_long_text_leaves_no_shard_empty(spark):
    rng = random.Random(9)
    docs = [(0, "a" * 60_000)] + [(k, "".join(rng.choices("abcdefgh", k=rng.randint(50, 1300)))) for k in range(1, 1001)]
    out = sharding.assign_shards(spark.createDataFrame(docs, "doc_id long, text string"), 24).groupBy("shard").agg({"size": "sum"}).collect()
    loads = sorted(r[1] for r in out)
    mean = (sum(loads) - loads[-1]) / 23
    assert len(loads) == 24 and loads[0] > 0.9 * mean and loads[-2] < 1.1 * mean and loads[-1] < 1.05 * 60_008


def test_documents(spark):
    texts = ["x", "", None, "ä" * 50, "same", "same", "same", "long " * 400] + [f"text {i} " * (i % 7) for i in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(4, "same", "s"), (None, "same", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string").selectExpr("*", "'a' as row", "'b' as part", "'c' as digest", "1.5 as shard")
    out = sharding.assign_shards(docs, 24, resolution=10).collect()
    assert len(out) == len(rows)
    by_text = {}
    known = dict(zip(range(len(texts)), texts))
    for r in out:
        text = "same" if r.doc_id is None else known[r.doc_id] or ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "bytes" and r.grown_shard is None
        by_text.setdefault(text, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    groups = {}
    for _, t, _ in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 8
    sizes = [groups[t] for t in sorted(groups, key=lambda t: hashlib.sha256(t.encode()).hexdigest())]
    loads = {}
    for r in out:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert max(loads.values()) == smallest_capacity(sizes, 24)


def test_hot_and_very_long_texts(spark, monkeypatch):
    """A third of all rows equal and without ids, in parts; one text larger than all others together."""
    monkeypatch.setattr(sharding, "PART_ROWS", 2)
    rows = [(None, "hot") for _ in range(300)] + [(k, f"t{k}") for k in range(600)] + [(7, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = sharding.assign_shards(docs, 5).collect()
    assert len(out) == len(rows) and len({r.shard for r in out if r.doc_id is None}) == 1
    for shard in range(5):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    assert max(sum(r.size for r in out if r.shard == s) for s in range(5)) >= 200_008
    again = sharding.assign_shards(docs.repartition(2), 5).where("doc_id is not null").collect()
    assert {(r.doc_id, r.size, r.shard) for r in again} == {(r.doc_id, r.size, r.shard) for r in out if r.doc_id is not None}


def test_ranges_follow_the_number_of_rows():
    assert [sharding.digits_for(n) for n in (0, 10**6, 16**3 * sharding.RANGE_GROUPS, 10**9, 10**11)] == [3, 3, 3, 4, 5]


def test_empty_table(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0
