import math
import random

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def brute(rows, k, scale=64):
    good = [(i, [math.floor(float(x) * scale) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(b) == len(a))
        out += [(q, r, c, -s) for r, (s, c) in enumerate(found[:k], 1)]
    return sorted(out)


def vectors(n, dim, seed, lattice=False):
    rng = random.Random(seed)
    draw = (lambda: rng.choice([-0.5, 0.0, 0.25])) if lattice else (lambda: rng.gauss(0, 1))
    return [(i, [float(F32(draw())) for _ in range(dim)], 1, "x") for i in range(n)]


def F32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 20 == 0, **kw).collect())


def test_against_brute_force(spark):
    rows = vectors(700, 12, 1)
    assert run(spark, rows, shard_rows=90) == brute(rows, 20)


def test_ties_and_blocks(spark):
    rows = vectors(500, 3, 2, lattice=True)
    assert run(spark, rows, k=7, shard_rows=64, query_rows=9) == brute(rows, 7)


def test_bad_vectors(spark):
    rows = vectors(60, 4, 3) + [(60, None, 1, "x"), (80, [1.0, None, 0.0, 1.0], 1, "x"), (100, [float("nan"), 0.0, 0.0, 0.0], 1, "x"), (120, [float("inf"), 0.0, 0.0, 0.0], 1, "x"), (None, [1.0, 1.0, 1.0, 1.0], 1, "x"), (140, [1.0, 2.0], 1, "x"), (141, [3.0, 2.0], 1, "x"), (160, [], 1, "x")]
    assert run(spark, rows) == brute(rows, 20)


def test_few_and_none(spark):
    rows = vectors(5, 4, 4)
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, []) == []
    assert run(spark, vectors(1, 4, 5)) == []


def test_repeated_and_clashing(spark):
    """Query rows that repeat an id ask together; candidates that repeat one keep their places."""
    rows = vectors(120, 5, 6) + [(20, [0.5] * 5, 1, "x"), (20, [0.5] * 5, 1, "x"), (40, vectors(1, 5, 9)[0][1], 1, "x"), (41, [0.25] * 5, 1, "x")]
    df = spark.createDataFrame([(i, v, s, r, "q") for i, v, s, r in rows], f"{SCHEMA}, query_id string").withColumnRenamed("score", "dim")
    out = sorted(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=6, shard_rows=40).collect())
    good = [(i, [math.floor(x * 64) for x in v]) for i, v, *_ in rows]
    expected = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        pool = sorted((-sum(x * y for x, y in zip(a, b)), c) for i, a in good if i == q for c, b in good if c != q)
        expected += [(q, r, c, -s) for r, (s, c) in enumerate(pool[:6], 1)]
    assert out == expected


def test_whole_subtrees_are_passed_by(monkeypatch):
    """Clustered vectors: a batch looks at few leaves, and results stay exact."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (40, 16))
    v = np.rint(np.repeat(centres, 100, 0) + rng.normal(0, 5, (4000, 16))).astype(np.int64)
    ids = rng.permutation(4000)
    tree = topk.BallTree(ids, v, leaf_rows=50)
    assert any(tree.children) and tree.children[0] is not None
    seen = []
    real = np.rint
    monkeypatch.setattr(topk.np, "rint", lambda x: seen.append(x.size) or real(x))
    q = v[::500]
    row, found, score = tree.search(ids[::500], q, 10, np.full(len(q), topk.LOWEST))
    monkeypatch.undo()
    assert sum(seen) < 0.25 * len(q) * len(v)
    scores = q @ v.T
    for k in range(len(q)):
        own = sorted((-s, i) for s, i in zip(scores[k].tolist(), ids.tolist()) if i != ids[::500][k])[:10]
        assert sorted((-s, i) for s, i in zip(score[row == k].tolist(), found[row == k].tolist())) == own


def test_regions_split_and_hot_vectors(spark, monkeypatch):
    """A third of all vectors equal, many regions and shards."""
    monkeypatch.setattr(topk, "REGIONS", 16)
    rows = vectors(400, 6, 8) + [(1000 + k, [0.5] * 6, 1, "x") for k in range(200)]
    assert run(spark, rows, shard_rows=30, k=5, query_rows=7) == brute(rows, 5)


def test_large_integers_stay_exact(spark):
    rows = [(i, [float(F32(x)) for x in (1e6 + i, -3e5 * i, 12345.678)], 1, "x") for i in range(40)]
    assert run(spark, rows) == brute(rows, 20)
