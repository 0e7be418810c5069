import random
import re
from itertools import combinations

import corpus_pipeline
from geoloom.llm import components, minhash, wordhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, n=5):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    rows = sorted({(i, t or "") for i, t in rows if i is not None})
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        alike = rows[a][1] == rows[b][1] if not sets[a] and not sets[b] else len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
        if alike:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {rows[k][0]: (rows[find(k)][0], links[k]) for k in range(len(rows))}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)] + ["Éa", "ß", "中文"]
    out = []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "  ", ", "]).join(text))
    rng.shuffle(out)
    return list(enumerate(out))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_links int")


def test_against_brute_force(spark):
    rows = corpus(1) + [(900, None), (901, ""), (902, "!!! ###"), (903, "!!! ###"), (904, "***"), (905, "one two"), (906, "ONE, two"), (907, "x " * 20000), (None, "one two"), (905, "one two")]
    out = {r.doc_id: (r.class_id, r.n_links) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert out == brute(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    rng = random.Random(2)
    base = [f"v{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(70):
        text = list(base)
        for _ in range(i % 5):
            text[rng.randrange(150)] = f"n{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    out = {r.doc_id: (r.class_id, r.n_links) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert out == brute(rows)


def test_clashing_columns_and_very_long_texts(spark):
    rng = random.Random(8)
    long = [f"v{rng.randrange(4000)}" for _ in range(80_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:70_000])), (3, " ".join(long[:40_000])), (4, " ".join(["more", *long])), (5, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as th", "'y' as node", "array(1L) as bands", "'z' as class_id", "1 as part")
    out = {r.doc_id: (r.class_id, r.n_links) for r in minhash.near_duplicates(docs).collect()}
    assert out == brute(rows)


def test_empty_table(spark):
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_bands_reach_the_recall():
    bands, rows = minhash.bands_for(0.8, 0.9998)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9998 and bands * rows <= 128


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(200)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)] + [(5000, 5000), (None, 3)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(201))
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges[200:240]:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert all(out[a] == find(a) for a, b in edges[200:240] if a != b)


def test_word_hashes_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["a b c", "", "  ", "c, B; a", "été Été", "x" * 300]
    whole = wordhash.words(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        one = wordhash.words(pa.array([t], pa.large_string()))
        assert one.hashes.tolist() == whole.hashes[whole.offsets[k] : whole.offsets[k + 1]].tolist()
        assert len(one.hashes) == len(WORD.findall(t.lower()))


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus(4) + [(2000, "a b c d e f g"), (2000, "a b c d e f g"), (None, "kept without id"), (None, "kept without id")]
    docs = docs_of(spark, rows)
    kept = corpus_pipeline.ngram_jaccard(spark, docs, "")
    assert kept.columns == docs.columns
    expected = sorted({c for c, _ in brute(rows).values()})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == expected
    assert kept.where("doc_id is null").count() == 2
