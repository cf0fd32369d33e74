"""From raw documents to packed sequences: each stage reads what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquarry.llm import language, nearcopies, packing, repeats, secrets
from clipquarry.llm.queries import WORD_BPE
from clipquarry.llm.shared import landed, prepared
from clipquarry.sources.tables import table


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with `n_chars` brought up to date."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some language: texts that are null, have no letter or are like no profile go."""
    prepared(spark)
    return language.in_known_language(docs, language.learnt(docs))


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id: texts whose SimHash fingerprints link, or that MinHash
    brings together, are near copies if 0.8 of their five-word shingles or more are alike."""
    prepared(spark)
    return nearcopies.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without long strings that occur earlier; documents of which nothing is left go."""
    prepared(spark)
    cut = repeats.without_repeats(docs).filter(F.length("text") > 0)
    return _counted(cut, docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with what looks like a secret replaced by a mark."""
    prepared(spark)
    return _counted(secrets.redacted(docs, secrets.scan(docs)), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of which the training sequences consist."""
    prepared(spark)
    return packing.packed(docs, WORD_BPE)


STAGES = [
    ("language", known_language),
    ("near copies", near_unique),
    ("repeats", without_repeats),
    ("secrets", without_secrets),
    ("packing", sequences),
]

# Hashing and tokenizing have no SQL form; the tests run the same steps by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
