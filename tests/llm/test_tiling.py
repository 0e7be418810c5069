import random
import re
import time

import numpy as np

from geoloom.llm import tiling, wordhash

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one two three"), (3, None), (4, ""), (5, "Se que osllra ñezll del does mente raarga ñasquera rrie")]
CLEAN = "nothing here is taken from any other place at all and goes on"


def run(spark, docs, items=ITEMS, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in tiling.find_contamination(d, b, keep=["doc_id"], **kw).collect()}


def test_cases(spark):
    docs = [
        (1, f"{CLEAN} Alpha, beta gamma; DELTA epsilon zeta eta theta iota kappa lambda mu {CLEAN}"),
        (2, f"eta theta iota kappa lambda mu {CLEAN} alpha beta gamma delta epsilon zeta"),  # another order
        (3, f"{CLEAN} alpha beta gamma delta {CLEAN}"),  # a third
        (4, CLEAN), (5, None), (6, ""), (7, "say one two three now"), (8, "one two"),
        (9, "se QUE osllra ñezll del does mente raarga ñasquera rrie"), (10, ("alpha beta gamma delta " * 3000)), (None, "one two three"),
    ]
    out = run(spark, docs)
    assert {k for k, r in out.items() if r.contaminated} == {1, 2, 7, 9, None}
    assert out[1].max_coverage == 1.0 and out[2].max_coverage == 1.0 and out[3].max_coverage == 0.0
    assert [(x.item_id, x.words) for x in out[1]["items"]] == [(1, 12)]
    low = run(spark, docs, threshold=0.3)
    assert low[3].contaminated and abs(low[3].max_coverage - 4 / 12) < 1e-9 and abs(low[10].max_coverage - 4 / 12) < 1e-9


def test_blocks_give_the_same(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(25)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(20)) + " " + (items[k % 25][1] if k % 3 else "")) for k in range(60)]
    pick = lambda out: {k: (r.n_items, r.max_coverage, sorted(tuple(x) for x in r["items"])) for k, r in out.items()}
    assert pick(run(spark, docs, items)) == pick(run(spark, docs, items, block_bytes=100))


def test_empty_tables(spark):
    assert run(spark, []) == {}
    out = run(spark, [(1, CLEAN)], [])
    assert not out[1].contaminated and out[1].n_items == 0


def greedy(doc, item, least):
    """The textbook form: scan all pairs of unmarked places, mark the longest runs, repeat."""
    dm, im, marked = [False] * len(doc), [False] * len(item), 0
    while True:
        best, found = least, []
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n] and not im[p + n] and not dm[d + n]:
                    n += 1
                if n > best:
                    best, found = n, [(d, p)]
                elif n == best:
                    found.append((d, p))
        if not found:
            return marked
        for d, p in sorted(found):
            if any(dm[d : d + best]) or any(im[p : p + best]):
                continue
            dm[d : d + best] = [True] * best
            im[p : p + best] = [True] * best
            marked += best


def hashed(numbers):
    return wordhash.mix(np.array(numbers, np.uint64) + np.uint64(1))


def test_tiles_equal_the_textbook():
    rng = random.Random(2)
    for _ in range(500):
        kinds, least = rng.choice([2, 3, 4, 8]), rng.choice([1, 2, 3])
        doc, item = [rng.randrange(kinds) for _ in range(rng.randint(0, 30))], [rng.randrange(kinds) for _ in range(rng.randint(0, 18))]
        expected = greedy(doc, item, least)
        assert sum(n for *_, n in tiling.tile(hashed(doc), hashed(item), least)) == expected
        assert tiling.covered(hashed(doc), hashed(item), least, 0.0) == expected


def test_long_repetitive_pairs_take_no_long():
    doc, item = [k % 7 for k in range(20_000)], [k % 7 if k % 50 else 9 for k in range(2_000)]
    began = time.perf_counter()
    assert tiling.covered(hashed(doc), hashed(item), 4, 0.5) == 1960
    assert tiling.covered(hashed([1] * 20_000), hashed([1] * 2_000), 4, 0.5) == 2_000
    assert time.perf_counter() - began < 2


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute(docs, items, least=4, threshold=0.5):
    """(n_items, max_coverage) by row, every document against every item."""
    out = []
    for i, text in docs:
        hits = []
        for item_id, item in {(i, t) for i, t in items if t}:
            w = words_of(item)
            marked = greedy(words_of(text), w, min(least, len(w))) if w else 0
            if marked and marked >= threshold * len(w):
                hits.append((item_id, marked / len(w)))
        out.append((i, len({i for i, _ in hits}), max((c for _, c in hits), default=0.0)))
    return sorted(out, key=str)


def test_whole_query_against_brute_force(spark):
    """Shuffled, split and repeated passages, by both ways of joining."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for k in range(20)] + [(3, "w1 w2 w3 w4 w5"), (20, None), (21, ""), (22, "w9"), (None, "w7 w8 w7 w8 w7")]
    docs = []
    for k in range(50):
        parts = (items[k % 20][1] or "").split()
        at = rng.randint(0, len(parts))
        docs.append((k, " ".join([*parts[at:], "gap", *(rng.choice(words) for _ in range(rng.randint(0, 15))), *parts[:at]] * rng.choice([1, 1, 3]))))
    docs += [(60, None), (61, ""), (7, docs[7][1]), (None, docs[3][1]), (62, "w9 " * 400)]
    expected = brute(docs, items)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, coverage string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (tiling.BLOCK_BYTES, 10):
        out = tiling.find_contamination(d, b, block_bytes=block_bytes)
        assert out.columns == ["doc_id", "text", "coverage", "items", "n_items", "max_coverage", "contaminated"]
        rows = out.collect()
        assert sorted(((r.doc_id, r.n_items, r.max_coverage) for r in rows), key=str) == expected
        assert all(r.contaminated == (r.max_coverage >= 0.5) for r in rows)


def test_no_pair_is_lost_to_rarest_seeds():
    rng = random.Random(5)
    reached = 0
    for _ in range(2000):
        kinds, size, threshold = rng.choice([2, 3, 6]), rng.choice([1, 2, 3]), rng.choice([0.3, 0.5, 0.9, 1.0])
        item = [rng.randrange(kinds) for _ in range(rng.randint(size, 18))]
        doc = [rng.randrange(kinds) for _ in range(rng.randint(0, 12))] + (item[: rng.randint(0, len(item))] if rng.random() < 0.5 else [])
        own, shared = np.unique(tiling.run_hashes(hashed(item), size)).view(np.int64), tiling.run_hashes(hashed(doc), size).view(np.int64)
        seeds = np.sort(own[np.array([s in shared or rng.random() < 0.5 for s in own], bool)])
        kept = tiling.rarest(hashed(item), size, seeds, np.array([rng.randint(1, 4) for _ in seeds], np.int64), threshold)
        if greedy(doc, item, size) >= threshold * len(item):
            reached += 1
            assert np.isin(kept, shared).any()
    assert reached > 100


def test_a_stock_phrase_makes_no_pairs(spark):
    """A phrase of every document and item: with all seeds, all of them would meet."""
    stock = "answer the question below with one of the given choices only"  # 11 words of 30
    items = [(k, f"{stock} " + " ".join(f"i{k}w{n}" for n in range(19))) for k in range(40)]
    docs = [(k, f"d{k} {stock} " + (items[k][1] if k < 10 else f"e{k} f{k}")) for k in range(60)]
    seeds = lambda rows, sizes: spark.createDataFrame([(str(k), t, sizes) for k, t in rows], "key string, t string, sizes array<int>")
    item_seeds = seeds(items, None).mapInArrow(tiling.seeds_of(4), tiling.SEED_DDL)
    shared = seeds(docs, [4]).mapInArrow(tiling.seeds_of(None), tiling.SEED_DDL).select(tiling.F.col("key").alias("text_key"), "size", "seed").join(item_seeds.select("size", "seed").distinct(), ["size", "seed"], "left_semi")
    pairs = tiling.meeting_pairs(shared, item_seeds, seeds(items, None), 0.5)
    assert sorted((int(r.text_key), int(r.item_key)) for r in pairs.collect()) == [(k, k) for k in range(10)]
    assert {k for k, r in run(spark, docs, items, block_bytes=10).items() if r.contaminated} == set(range(10))
