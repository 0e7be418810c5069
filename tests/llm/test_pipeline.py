import hashlib
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = corpus_pipeline.language_id(spark, docs, SF)
    assert known.columns == docs.columns
    letters = [r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    assert sorted(r.doc_id for r in known.collect()) == sorted(letters)
    kept = corpus_pipeline.ngram_jaccard(spark, known, SF)
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in brute(rows).values()})
    clean = corpus_pipeline.decontamination(spark, kept, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holding = {r.doc_id for r in kept.collect() if any(t in r.text for t in items)}
    gone = {r.doc_id for r in kept.collect()} - {r.doc_id for r in clean.collect()}
    assert holding <= gone and len(gone) <= len(holding) + 3
    assert corpus_pipeline.run(spark, SF).count() == clean.count()


def test_languages_decide(spark):
    """Wanted languages, unknown scripts, encoded data and a missing label."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    more = [(10_001, "Это русский текст, которого модель не видела. " * 5, "ru"), (10_002, "这是一个没有学过的文字系统 " * 40, None), (10_003, docs.where("lang = 'de'").first().text, None)]
    rows = [tuple(r) for r in docs.collect()] + more
    both = spark.createDataFrame(rows, docs.schema)
    learned = both.where("doc_id <> 10001")  # a label of one long text would be learned
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, learned, SF).collect()} == {i for i, *_ in rows if i < 10_001} | {10_003}
    german = corpus_pipeline.language_id(spark, learned, SF, languages=("de",)).collect()
    assert {r.lang for r in german} == {"de"} and 10_003 in {r.doc_id for r in german}
    unseen = spark.createDataFrame([(i, t, None if i == 10_001 else g) for i, t, g in rows], docs.schema)
    assert 10_001 not in {r.doc_id for r in corpus_pipeline.language_id(spark, unseen, SF).collect()}


def test_empty_tables_long_texts_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    long = " ".join(f"wort{k % 977} und" for k in range(60_000))
    three = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 3 != 1)
    short = "Der Tag und die Nacht und das Wort"
    rows = [(1, long, "de"), (1, long, "de"), (2, long + " mehr", "de"), (three, short, "de"), (three, short, "de"), (4, None, "de"), (5, "", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.language_id(spark, odd, SF)
    assert sorted(r.doc_id for r in out.collect()) == [1, 1, 2, three, three]
    kept = corpus_pipeline.ngram_jaccard(spark, odd, SF)
    assert sorted((r.doc_id, len(r.text or "")) for r in kept.collect()) == [(1, len(long)), (4, 0), (three, len(short))]
    clean = corpus_pipeline.decontamination(spark, odd, SF)
    assert clean.count() == len(rows)
    pieces = {r.doc_id: r for r in corpus_pipeline.piece_encoding(spark, odd, SF).collect()}
    assert pieces[4].ids == [] and len(pieces[1].ids) == pieces[1].n_tokens and pieces[1].ends[-1] == len(long)


def test_columns_with_the_names_of_results(spark):
    rows = [(1, "The first text of all", "en", "a", 1), (2, None, "en", "b", 2), (3, "123", "en", "c", 3), (None, "one more text", "en", "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, items int").withColumn("contaminated", docs_flag())
    out = corpus_pipeline.language_id(spark, docs, SF)
    assert out.columns == docs.columns and sorted(r.lang_pred for r in out.collect()) == ["a", "d"]
    clean = corpus_pipeline.decontamination(spark, out, SF)
    assert sorted((r["items"], r.contaminated) for r in clean.collect()) == [(1, "x"), (4, "x")]


def test_doc_ids_on_several_texts(spark):
    def words(k):
        return " ".join(f"w{k}x{j}" for j in range(30))

    rows = [(1, words(0), "a"), (5, words(0), "a"), (5, words(1), "a")]  # a copy and a unique text
    rows += [(6, words(2), "a"), (6, words(3), "a")]  # two unrelated texts
    rows += [(7, words(4), "x"), (7, words(4), "w"), (7, words(4), "y")]  # repeats of id and text
    rows += [(2, words(5), "a"), (9, words(5), "a"), (9, words(6), "a"), (10, words(6), "a")]  # one id in two classes
    rows += [(8, words(7), "a"), (8, words(7) + " more", "a")]  # near copies under one id
    rows += [(None, words(8), "a"), (None, words(8), "a"), (11, None, "b"), (11, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tags", F.create_map(F.lit("k"), "source"))
    out = corpus_pipeline.ngram_jaccard(spark, docs.repartition(5), SF)
    assert out.columns == docs.columns
    found = sorted(((r.doc_id or 0, r.text or "", r.source) for r in out.collect()), key=str)
    near = min(rows[12:14], key=lambda r: hashlib.sha256(r[1].encode()).digest())
    sure = [rows[k] for k in (0, 2, 3, 4, 6, 8, 10)] + [near, (0, words(8), "a"), (0, words(8), "a"), (11, "", "b")]
    assert found == sorted(sure, key=str)


def docs_flag():
    from pyspark.sql import functions as F

    return F.lit("x")
