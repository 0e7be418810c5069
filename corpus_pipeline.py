"""From raw documents to encoded training text, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import language, minhash, queries, tiling
from geoloom.llm.storage import discard, materialise

#: Languages that stay; None: all that the model has learned.
LANGUAGES: tuple[str, ...] | None = None
#: A document stays if the model has seen at least this share of its character n-grams.
#: Text in learned languages has 0.75 or more of them, other scripts 0.1 or less.
LEAST_FAMILIAR = 0.4


def plain(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents under names that no operator's results have, and the text's name among them."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, *, languages: tuple[str, ...] | None = LANGUAGES, least_familiar: float = LEAST_FAMILIAR) -> DataFrame:
    """Documents whose predicted language is wanted; a null `lang` becomes the prediction.

    Null texts, texts without a letter and texts of which the model has seen too
    few n-grams have no known language and go. Rows that repeat are judged alike;
    an empty table gives no rows, and so does one without a row to learn from.
    """
    model = language.fit_languages(docs, queries.learnable())
    own, text = plain(docs)
    found = language.identify_languages(own, model, text_col=text)
    stays = (F.col("lang_pred") != language.UNKNOWN) & (F.col("familiar") >= least_familiar)
    if languages is not None:
        stays = stays & F.col("lang_pred").isin(*languages)
    label = own.columns[docs.columns.index("lang")]
    kind = own.schema[label].dataType
    return found.where(stays).withColumn(label, F.coalesce(label, F.col("lang_pred").cast(kind))).select(own.columns).toDF(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id.

    Rows without a doc_id stay. Rows with the same doc_id and different texts are
    different documents, in the order of their texts' SHA-256; of rows that repeat
    both (null text: empty) the one stays that sorts first by its columns from
    left to right. Texts of any length count whole; an empty table gives no rows.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        extra = minhash.near_duplicates(docs).where("class_id <> doc_id").select("doc_id")
        return docs.join(extra.hint("merge"), "doc_id", "left_anti").select(docs.columns)  # ids grow with the data: no broadcast
    own, text = plain(docs)
    ident = own.columns[docs.columns.index("doc_id")]
    numbered = materialise(number_documents(own, ident, text), "numbered")
    extra = minhash.near_duplicates(numbered, id_col="_number", text_col=text).where("class_id <> doc_id").select(F.col("doc_id").alias("_number"))
    kept = numbered.join(extra.hint("merge"), "_number", "left_anti").select(own.columns)
    return kept.unionByName(own.where(F.col(ident).isNull())).toDF(*docs.columns)


def number_documents(own: DataFrame, ident: str, text: str) -> DataFrame:
    """A row for each doc_id and text, with a _number that grows with both."""
    order = F.struct(*(F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in own.schema))
    first = own.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_id"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("_sha")).agg(F.min_by(F.struct(*own.columns), order).alias("_row"))
    return first.orderBy("_id", "_sha").select("_row.*", F.monotonically_increasing_id().alias("_number"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to the threshold.

    Null and empty texts hold none and stay, as do rows that repeat; very long
    texts are looked through whole. An empty table gives no rows.
    """
    own, text = plain(docs)
    found = tiling.find_contamination(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col=text)
    return found.where("not contaminated").select(own.columns).toDF(*docs.columns)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids with their byte spans in the text, n_tokens and digests of ids and decoded text.

    A null text is an empty one, without ids. Rows that repeat are encoded alike;
    very long texts whole; an empty table gives no rows.
    """
    return queries.encoded_pieces(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: Kernel regression, MinHash components and piece merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "stage")
            discard(spark, before)  # the table of the stage before, if it was one
    return docs
