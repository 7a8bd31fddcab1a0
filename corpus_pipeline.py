"""From documents to training token ids: the corpus operators as a chain of stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and its
decisions take effect. All but the last return the columns of documents; the last gives ids.

Defined results: a null text counts as empty and fails the quality rules; null languages, sources
and lengths pass through; a null doc_id ranks below all others among exact copies, is a group of its
own among near copies and an id like any other in the mix; rows that repeat are one text, of which one
stays; columns beyond those of documents go; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import exact_dedup, mixing, near_dup, quality, sentencepiece_codec
from lorekeep.llm.common import table, written
from lorekeep.llm.queries import MODEL_PATH

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, trusted).select(COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text stays, that with the largest doc_id."""
    return exact_dedup.one_of_each(docs).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return near_dup.one_of_each(docs).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs).select(COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids and the token ids of each document's whole text."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(MODEL_PATH))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("source mix", source_mix),
    ("piece ids", piece_ids),
]

#: Hashed n-grams, sketches and piece ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage written as a table and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
