import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import language, queries

WORDS = {"en": "the and of that with have from this there which would about", "de": "der die und nicht eine sich auch werden über für ist von", "es": "que los para una con por como más pero sus también año"}


def make(n):
    rows = []
    for i in range(n):
        lang = ["en", "de", "es"][i % 3]
        words = WORDS[lang].split()
        rows.append((i, " ".join(words[(i * 7 + k * k) % len(words)] for k in range(12 + i % 9)), lang, "src"))
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(spark):
    docs = docs_of(spark, make(300))
    model = language.fit_languages(docs, queries.learnable())
    out = language.identify_languages(docs, model, keep=["doc_id", "lang"]).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_only_learnable_rows_count(spark):
    rows = make(120)
    flipped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else g, s) for i, t, g, s in rows]
    a, b = (language.fit_languages(docs_of(spark, r), queries.learnable()) for r in (rows, flipped))
    assert a.labels == b.labels and (a.weights == b.weights).all()


def test_odd_rows(spark):
    rows = make(90) + [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "123 !?", "de", "s"), (1003, "the and of " * 9000, None, "s"), (None, "der und die", "de", "s"), (5, "die und der", "de", "s"), (1004, "中文字", "en", "s")]
    docs = docs_of(spark, rows)
    model = language.fit_languages(docs, queries.learnable())
    out = language.identify_languages(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "familiar"]
    by_id = {r.doc_id: r for r in out.collect()}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000].score == 0
    assert by_id[1003].lang_pred == "en" and by_id[None].lang_pred == "de" and by_id[1004].lang_pred in model.labels


def test_familiar_is_the_share_of_known_grams(monkeypatch):
    texts = [r[1] for r in make(30)]
    model = language.fit(texts, [r[2] for r in make(30)], landmarks=30)
    known = {t[k : k + n] for n in (1, 2, 3) for t in texts for k in range(len(t) - n + 1)}
    for chunk in (language.CHUNK, 5):
        monkeypatch.setattr(language, "CHUNK", chunk)
        for text in (texts[3], "Это русский текст", "the zzz über", "", "Ж"):
            grams = [text.lower()[k : k + n] for n in (1, 2, 3) for k in range(len(text) - n + 1)]
            assert abs(model.look(text)[1] - sum(g in known for g in grams) / max(len(grams), 1)) < 1e-12


def test_nothing_to_learn(spark):
    docs = docs_of(spark, [(1, "text", None, "s")])
    model = language.fit_languages(docs, queries.learnable())
    assert [r.lang_pred for r in language.identify_languages(docs, model).collect()] == ["und"]
    empty = docs_of(spark, [])
    assert language.identify_languages(empty, language.fit_languages(empty, F.lit(True))).count() == 0


def test_presence_kernel_equals_sets():
    texts = [r[1] for r in make(12)]
    model = language.fit(texts, [r[2] for r in make(12)], landmarks=12)
    grams = [{t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)} for t in texts]
    here = model.presence(texts).astype(int)
    assert ((here @ here.T) == [[len(a & b) for b in grams] for a in grams]).all()


def test_letters_of_many_scripts():
    """Chinese, Japanese and Korean, and rare scripts beside much Latin text, are told apart."""
    alphabets = {"zh": "的一是不了人我在有他这中大来上", "ja": "のにはをたがでてとしれさある日", "ko": "이다는을에의가고하로한지도서나", "el": "αβγδεζηθικλμνξο", "ka": "აბგდევზთიკლმნოპ", "he": "אבגדהוזחטיכלמנס", "got": "𐌰𐌱𐌲𐌳𐌴𐌵𐌶𐌷𐌸𐌹𐌺𐌻𐌼𐌽𐌾"}
    rows = [(" ".join("".join(letters[(i * 7 + j * k) % 15] for k in range(2 + j % 4)) for j in range(1, 12)), lang) for lang, letters in alphabets.items() for i in range(12)]
    latin = "".join(map(chr, range(0x100, 0x180)))
    rows += [(latin[i:] + " the and of " * 200, "en") for i in range(12)]
    model = language.fit([t for t, _ in rows[::2]], [g for _, g in rows[::2]])
    texts, labels = zip(*rows[1::2])
    assert [model.labels[k] for k in model.scores(list(texts)).argmax(1)] == list(labels)
    assert model.places[2] is None  # by search


def test_presence_of_rare_and_high_letters(monkeypatch):
    texts = ["漢字かな交じり文", "한국어 문장", "漢字文", "𐌰𐌱𐌲 12,5%", "12.5%\t漢\n字", ""]
    grams = [{t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)} for t in texts]
    for size in (language.DIRECT, 0):
        monkeypatch.setattr(language, "DIRECT", size)
        monkeypatch.setattr(language, "CHUNK", 4)
        model = language.fit(texts, list("abcdef"), landmarks=6)
        here = model.presence(texts).astype(int)
        assert ((here @ here.T) == [[len(a & b) for b in grams] for a in grams]).all()


def test_scores_equal_kernel_ridge_regression():
    rows = make(30)
    texts, labels = [r[1] for r in rows], [r[2] for r in rows]
    model = language.fit(texts, labels, landmarks=12)
    here = model.presence(texts).astype(float)
    here /= np.sqrt(here.sum(1, keepdims=True))
    chosen = [i for name in model.labels for i in [k for k, x in enumerate(labels) if x == name][:4]]
    anchor = here[chosen]
    values, vectors = np.linalg.eigh(anchor @ anchor.T)
    sound = values > 1e-6 * values.max()
    space = here @ anchor.T @ (vectors[:, sound] / np.sqrt(values[sound]))
    hot = np.array([[x == name for name in model.labels] for x in labels], float)
    solved = np.linalg.solve(space.T @ space + 1e-2 * 30 * np.eye(space.shape[1]) / 100, space.T @ hot)
    assert np.allclose(model.scores(texts), space @ solved, atol=1e-4)


def test_every_label_is_learned(spark):
    letters = [chr(0x4E00 + k) for k in range(230)]
    docs = docs_of(spark, [(3 * k + i, letters[k] * 3, f"l{k:03}", "s") for k in range(230) for i in range(3)])
    model = language.fit_languages(docs, F.lit(True))
    found = language.identify_languages(docs, model).collect()
    assert len(model.labels) == 230 and all(r.lang == r.lang_pred for r in found)
    with pytest.raises(ValueError, match="max_labels"):
        language.fit_languages(docs, F.lit(True), max_labels=229)
