"""From documents to packed sequences: language, quality, near duplicates, benchmark leaks, packing.

Each stage takes what the one before it kept. The first four return the columns of documents; the last returns a row per piece of a document. A row
with a null or empty text fails the first stage, as its language is undetermined. Models are fitted on the tables of sf_dir. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, minhash, packing, quality
from .common import bounded, held_out, read, stored
from .tokens import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    return langid.fit(read(spark, sf_dir, "documents").where(~held_out(5)))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    labels = read(spark, sf_dir, "labels").where(~held_out(5))
    return quality.fit(*quality.sample(read(spark, sf_dir, "documents"), labels))


@bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of undetermined language: a null text, or one without a letter."""
    return langid.predict(docs.select(*COLUMNS), language_model(spark, sf_dir), *COLUMNS).where("lang_pred <> 'und'").select(*COLUMNS)


@bounded
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier calls bad."""
    return quality.score(docs.select(*COLUMNS), quality_model(spark, sf_dir), *COLUMNS).where("predicted = 1").select(*COLUMNS)


@bounded
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each class of near duplicates (five words, similarity 0.8).

    Rows without an id stay. Rows with one id are one document, of which one row stays: that whose text has the smallest hash.
    """
    found = minhash.near_duplicates(docs, width=5, percent=80)
    keep = found.where("kept and doc_id is not null").groupBy("doc_id").agg((F.count("*") > 1).alias("_many"))
    rows = docs.select(*COLUMNS).join(keep, "doc_id", "inner").select(*COLUMNS, "_many")
    # rows of equal ids are rare: only they are dealt out once more
    order = F.struct(F.xxhash64("text"), F.xxhash64("lang", "source", "n_chars"))
    many = rows.where("_many").groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS), order).alias("x")).select("x.*")
    return rows.where("not _many").select(*COLUMNS).unionByName(many).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


@bounded
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out, and drops documents that mostly consist of them. A changed text changes n_chars."""
    kept = decontaminate.remove(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), most_words=120_000))


STAGES = [("language_id", language), ("quality_classifier", good), ("minhash_dedup", distinct), ("decontamination", clean), ("best_fit_packing", packed)]

#: Classifiers, minima and packing are no SQL; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
