"""License scans by exact set-similarity join, in DataFrame operations.

A template is a license wording of any length, a row of (label, text). Every text
is cut, for each template it may hold, into blocks of twice the template's words
that overlap by half, so a passage of the template's length lies whole in one. A
block meets a template when it holds at least `threshold` of the template's
distinct words (containment). The templates' words are ranked by the number of
documents that hold them, rarest first:

* prefix filter: of a template with n distinct words, a block that holds
  need = ceil(threshold * n) of them holds one of the n - need + 1 rarest; these
  make an inverted index, and documents are joined to it by the words they hold;
* length filter: a text needs `need` words, and a block `need` distinct words of
  the templates, at least;
* positional filter: with the first shared word at place p of the template and q of
  the block (both in rank order), no more than 1 + min(n - p, m - q) can be shared.

What passes is verified on whole sets. Only words of documents that hold a prefix
word are ever shuffled, keyed by (row, template, block), a group of bounded size.
The index is joined by Spark's own choice: broadcast if its measured size allows,
else by a shuffle whose hot words are split. Texts are read twice: to count words,
and to scan.

Beside it, each place where a phrase's words stand one after the other counts as
a base match. Words: A-Z folded, then runs of the pattern `WORD`. Null texts are
empty. Rows that repeat a doc_id each get a row; words that are equally rare rank
by spelling. Very long texts only make more blocks. Other columns, whatever their
names, are not read. An empty table gives no rows; without templates only base
matches are found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .licence_texts import TEMPLATES
from .storage import materialise, scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_RE = re.compile(WORD)
#: What stands between words: runs of all other characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: phrase -> label, fixed by the operator's contract.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

def folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Words of a folded text, in order: cutting between them costs less than matching them."""
    return F.array_remove(F.split(text, BETWEEN), "")


def phrase_starts(words: str, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    w = F.col(words)
    places = F.sequence(F.lit(0), F.greatest(F.size(w) - F.lit(len(parts)), F.lit(0)))
    ok = lambda i: F.forall(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(parts))), lambda s: F.get(w, i + s["k"]) == s["p"])
    return F.when(F.array_contains(w, parts[-1]) & F.array_contains(w, parts[0]), F.filter(places, ok)).otherwise(F.array().cast("array<int>"))


def templates_in(spark: SparkSession, folder: str) -> DataFrame:
    """label and text of every text file in a folder; the label is the file's name without its ending."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt|\.md)?$", 1)
    return spark.read.text(folder, wholetext=True).select(name.alias("label"), F.col("value").alias("text"))


def parsed(templates: DataFrame) -> DataFrame:
    """template, label, half (words with repeats) and word: a row a distinct word; templates without words have none."""
    words = templates.where(F.col("label").isNotNull()).select("label", words_of(folded(F.col("text"))).alias("w")).distinct()
    numbered = words.where(F.size("w") > 0).select(F.xxhash64("label", "w").alias("template"), "label", F.size("w").alias("half"), "w")
    return numbered.select("template", "label", "half", F.explode(F.array_distinct("w")).alias("word"))


def within(words: str, vocabulary: list[str]) -> Column:
    """The words of an array that are in a vocabulary, by one hash set for all rows; words hold no quotes."""
    listed = ", ".join(f"'{w}'" for w in vocabulary) or "''"
    return F.array_distinct(F.expr(f"filter({words}, w -> w in ({listed}))"))


def indexed(spelled: DataFrame, counts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(word, rank) of the vocabulary, and templates with ranks (rarest first), n and need.

    The window over the vocabulary is one of the templates' words, whatever the documents' size.
    """
    vocabulary = spelled.select("word").distinct().join(counts, "word", "left")
    order = Window.partitionBy(F.lit(0)).orderBy(F.coalesce("n_docs", F.lit(0)), "word")
    ranked = vocabulary.select("word", F.row_number().over(order).alias("rank"))
    sets = spelled.join(ranked, "word").groupBy("template", "label", "half").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    n = F.size("ranks")
    return ranked, sets.withColumn("n", n).withColumn("need", F.greatest(F.lit(1), F.ceil(n * threshold - 1e-9).cast("int")))


def scan_licences(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates: DataFrame | list[tuple[str, str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label and containment of the best block).

    The result is a written table; all others are deleted.
    """
    spark = docs.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(TEMPLATES if templates is None else templates, "label string, text string")
    with scratch(spark):
        return materialise(scanned(docs, phrases, templates, threshold, id_col, text_col), "licences", last=True)


def scanned(docs: DataFrame, phrases: dict[str, str], templates: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """The join of `scan_licences`, step by step."""
    words = docs.select(F.col(id_col).alias("doc_id"), words_of(folded(F.col(text_col))).alias("words"))
    spelled = materialise(parsed(templates), "templates")
    vocabulary = sorted(r["word"] for r in spelled.select("word").distinct().collect())  # bounded by the templates
    counts = materialise(words.select(F.explode(within("words", vocabulary)).alias("word")).groupBy("word").agg(F.count("*").alias("n_docs")), "counts")
    ranked, sets = (materialise(x, tag) for x, tag in zip(indexed(spelled, counts, threshold), ("ranks", "sets"), strict=True))
    prefixes = sets.select("template", "need", F.explode(F.slice("ranks", F.lit(1), F.col("n") - F.col("need") + 1)).alias("rank")).join(ranked, "rank").select("word", "template", "need")
    rare = sorted(r["word"] for r in prefixes.select("word").distinct().collect())

    named = [f"p{k}" for k in range(len(phrases))]
    scan = words.select("doc_id", F.size("words").alias("n_words"), *(phrase_starts("words", p).alias(n) for n, p in zip(named, phrases, strict=True)), within("words", rare).alias("rare"), "words")
    scan = scan.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", *named, "rare", F.when(F.size("rare") > 0, F.col("words")).alias("words"))
    scan = materialise(scan, "scan")

    pairs = scan.select("row", "n_words", F.explode("rare").alias("word")).join(prefixes, "word").where("n_words >= need").select("row", "n_words", "template").distinct()
    pairs = pairs.join(sets, "template").select("row", "n_words", "template", "half")
    tokens = scan.where("words is not null").select("row", F.posexplode("words").alias("at", "word")).join(ranked, "word").select("row", "at", "rank")
    last = F.floor(F.greatest(F.col("n_words") - F.col("half") - 1, F.lit(0)) / F.col("half")).cast("int")
    mine = F.floor(F.col("at") / F.col("half")).cast("int")  # the two blocks over a word
    held = pairs.join(tokens, "row").select("row", "template", "rank", F.explode(F.array_distinct(F.array(F.least(mine, last), F.least(F.greatest(mine - 1, F.lit(0)), last)))).alias("block"), (F.col("at")).alias("at"), "half")
    held = held.where((F.col("at") >= F.col("block") * F.col("half")) & (F.col("at") < (F.col("block") + 2) * F.col("half")))
    blocks = held.groupBy("row", "template", "block").agg(F.array_sort(F.collect_set("rank")).alias("own"))  # at most 2 * half ranks
    met = blocks.join(sets, "template")
    first = F.get(F.array_intersect(F.slice("ranks", F.lit(1), F.col("n") - F.col("need") + 1), F.col("own")), F.lit(0))
    met = met.where(F.size("own") >= F.col("need")).withColumn("first", first).where("first is not null")
    met = met.where(1 + F.least(F.col("n") - F.array_position("ranks", F.col("first")), F.size("own") - F.array_position("own", F.col("first"))) >= F.col("need"))
    shared = F.size(F.array_intersect("ranks", "own"))
    found = met.withColumn("shared", shared).where("shared >= need").groupBy("row", "label").agg(F.max(F.col("shared") / F.col("n").cast("double")).alias("containment"))
    matches = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "containment"))).alias("matches"))  # a label each

    no_places, no_labels = F.array().cast("array<int>"), F.array().cast("array<string>")
    places = F.concat(no_places, *(F.col(n) for n in named))
    base = F.concat(no_labels, F.array_compact(F.array(*(F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(named, phrases.values(), strict=True)))) if named else no_labels)
    rows = scan.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), places.alias("places"), base.alias("base")).join(matches, "row", "left")
    rows = rows.withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<label:string,containment:double>>")))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.concat("base", F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))).alias("score"), "matches",
    )
