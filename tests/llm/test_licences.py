import random
import re

from geoloom.llm import licences

WORD = re.compile(licences.WORD)


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, threshold=0.8, templates=licences.TEMPLATES):
    out = []
    for i, text in rows:
        w = words(text)
        places, base = [], set()
        for phrase, label in licences.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += hits
            if hits:
                base.add(label)
        best = {}
        for label, template in templates:
            t, half = set(words(template)), len(words(template))
            for at in range(0, max(len(w) - half - 1, 0) + 1, half) if t else ():
                share = len(t & set(w[at : at + 2 * half])) / len(t)
                if share >= threshold - 1e-9:
                    best[label] = max(best.get(label, 0), share)
        labels = base | set(best)
        out.append((str(i), len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(max([1.0 if base else 0.0, *best.values()]), 9)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1, ["w"]) for i, t in rows], "doc_id long, text string, labels string, row int, words array<string>")
    out = licences.scan_licences(df, **kw).collect()
    return sorted([(str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in out], key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = sorted({w for _, t in licences.TEMPLATES for w in words(t)}) + ["Straße", "中文", "x1"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 150)))) for k in range(40)]
    rows += [(100 + k, " ".join(["filler"] * rng.randint(0, 200) + [w for w in t.split() if rng.random() > 0.12] + ["tail"] * rng.randint(0, 90))) for k, t in enumerate([t for _, t in licences.TEMPLATES] * 3)]
    rows += [(500, "Released UNDER the MIT-License! Apache License, Version 2.0. CC BY-NC 4.0 cc by nc"), (501, None), (502, ""), (503, "the mit license " * 3000), (504, "ÀPACHE apache licence"), (None, "under the mit license"), (500, "dup"), (505, "under the mit license"), (505, "under the mit license"), (506, "commit license version 2")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


BSD = next(t for label, t in licences.TEMPLATES if label == "bsd")


def test_a_template_across_block_borders(spark):
    rows = [(lead, "pad " * lead + BSD + " end" * 40) for lead in (0, 9, 17, 19, 20, 31, 38, 61)]
    out = run(spark, rows)
    assert out == brute(rows) and {r[6] for r in out} == {"bsd"}


def test_ties_repeats_and_odd_templates(spark):
    """Words of equal frequency, repeated words and templates, empty and null ones, one label twice."""
    templates = [("a", "one two three four five"), ("a", "one one one two"), ("a", "one two three four five"), ("b", "five four three two one"), ("c", ""), ("d", None), (None, "x y"), ("e", "zz")]
    rows = [(1, "one two three four five"), (2, "five four"), (3, "two " * 50 + "one"), (4, "one two three four " + "x " * 30 + "five"), (5, None), (6, "zz"), (7, "ZZ zz " * 3000)]
    assert run(spark, rows, templates=templates) == brute(rows, templates=[(a, t) for a, t in templates if a and t])
    assert run(spark, rows, templates=[]) == brute(rows, templates=[])


def test_whole_license_texts_from_a_folder(spark, tmp_path):
    """Long texts as templates, with as many as a license list has."""
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(2_000)]
    texts = {f"l{k}": " ".join(rng.choice(pool) for _ in range(rng.choice([300, 900, 2_500]))) for k in range(60)}
    for label, text in texts.items():
        (tmp_path / f"{label}.txt").write_text(text)
    templates = licences.templates_in(spark, f"file://{tmp_path}")
    rows = []
    for k in range(12):
        text = texts[f"l{5 * k}"].split()
        rows.append((k, " ".join([*rng.choices(pool, k=700), *(w for w in text if rng.random() > 0.1), *rng.choices(pool, k=300)])))
    out = run(spark, rows, templates=templates)
    assert out == brute(rows, templates=list(texts.items()))
    assert all(f"l{5 * int(r[0])}" in r[6].split(",") for r in out)
