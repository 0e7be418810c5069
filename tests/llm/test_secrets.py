import base64
import hashlib
import random
import re
import string

import numpy as np
import pytest

from geoloom.llm import queries, secrets

SF = "/root/testdata/sf0.001"
FIXED = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def base_of(text):
    found = [(m.start(), list(FIXED).index(kind), f"{kind}:{m.start()}:{m.end()}") for kind, (p, g, least) in FIXED.items() for m in p.finditer(text or "") if len(m[g]) >= least]
    return ",".join(s for _, _, s in sorted(found))


def spans_of(spans):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS base", "'y' AS spans", "1 AS _text")
    return {r.doc_id: r for r in secrets.find_secrets(df).collect()}


def test_base_of_odd_texts(spark):
    rnd = random.Random(3)
    parts = ["token", "TOKEN", "ToKen", "ſecret", "tоken", "api_key", "APIKEY", "paſſword", "passwd", " = ", ":", "=", '"', "'", "AKIA", "AKIAAKIA", "abcdef0123456789", "0" * 31, "f" * 32, "-._=+/", "é", "K", "\n", "😀", "A1B2C3D4E5F6", "x" * 7, "x" * 8, " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(1500)] + [None, "", "token=" * 50_000 + "a" * 100_000]
    got = found(spark, texts)
    for k, text in enumerate(texts):
        assert spans_of(got[k].base) == base_of(text), text
        assert {s for s in map(str, got[k].base)} <= {s for s in map(str, got[k].spans)}


def test_query_over_the_whole_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_secrets(spark, SF).collect()}
    assert got.keys() == rows.keys()
    for k, r in got.items():
        base = base_of(rows[k])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(f"{kind}:") for s in base.split(",")) for kind in FIXED)
        assert r.spans == base  # nothing in the invented prose looks random


def words(rnd, n):
    return " ".join(rnd.choice(["the", "window", "Internationalisation", "camelCaseIdentifierName", "snake_case_name_of_it", "2024-11-28", "path/to/some/file", "counterrevolutionaries", "4111111111111111", "state-of-the-art"]) for _ in range(n))


def test_planted_random_strings_are_found_and_words_are_not(spark):
    rnd = random.Random(8)
    draw = lambda symbols, n: "".join(rnd.choice(symbols) for _ in range(n))
    planted, texts = {}, []
    makers = [lambda: draw(string.ascii_letters + string.digits, 32), lambda: base64.b64encode(rnd.randbytes(30)).decode().rstrip("="), lambda: draw(string.ascii_letters + string.digits + "-_", 43), lambda: draw("0123456789abcdef", 28)]
    for k in range(400):
        before, after = words(rnd, 40), words(rnd, 40)
        if k % 10 == 0:
            planted[k] = makers[k // 10 % 4]()
            texts.append(f"{before} {planted[k]} {after}")
        else:
            texts.append(f"{before} {after}")
    got = found(spark, texts)
    hits = {k: [texts[k][s.start : s.end] for s in r.spans] for k, r in got.items()}
    assert sum(planted[k] in hits[k] for k in planted) >= 0.9 * len(planted)
    assert sum(len(v) for k, v in hits.items() if k not in planted) == 0


def test_tests_hold_their_level_on_random_draws():
    rnd = random.Random(1)
    for n in (16, 32, 100):
        for symbols in (secrets.ALPHABETS["hex"], secrets.ALPHABETS["base62"], secrets.ALPHABETS["base64"]):
            p = np.array([secrets.tested("".join(rnd.choice(symbols) for _ in range(n)))[3] for _ in range(1500)])
            assert (p < 0.05).mean() < 0.08 and (p < 0.001).mean() < 0.006
    assert secrets.tested("a" * 40)[3] < 1e-6 and secrets.tested("0123456789abcdef" * 4)[3] < 1e-3


def test_moments_of_text_are_those_of_draws():
    rng = np.random.default_rng(0)
    counts = [0] * len(secrets.SYMBOLS) + [1000, 10]
    for k, s in enumerate(secrets.ALPHABETS["lower"]):
        counts[secrets.SYMBOLS.index(s)] = 1000 * (k + 1)
    corpus = secrets.corpus_of(counts)
    which = list(secrets.ALPHABETS).index("lower")
    share = np.arange(1, 27) / np.arange(1, 27).sum()
    drawn = rng.multinomial(60, share, size=4000)
    pairs = (drawn * (drawn - 1)).sum(1)
    assert corpus.squares[which] == pytest.approx((share**2).sum(), rel=0.01)
    p = secrets.against_text(np.full(4000, 60), np.full(4000, which), pairs, np.zeros(4000), corpus)
    assert 0.005 < (p < 0.05).mean() < 0.05  # half the level, as there are two tests


def test_levels_follow_the_number_of_tests():
    least = secrets.thresholds({(0, 0): 10_000, (0, 48): 5, (1, 40): 5, (2, 8): 1})
    assert least[0] == 43 and least[1] == 16 and least[2] > secrets.LEVELS and least[3] > secrets.LEVELS


def test_symbols_of_a_slice():
    import pyarrow as pa

    texts = pa.array(["zz9", "aB1-", "é0", "", "x"], pa.large_string())
    got = secrets.symbol_counts(texts.slice(1, 4))
    assert got[-2:].tolist() == [3, 3] and got[:-2].sum() == 6


def test_empty_table(spark):
    assert found(spark, []) == {}
