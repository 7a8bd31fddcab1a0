"""The registered queries of the corpus operators: thin wrappers over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import archive, exact_dedup, licences, line_dedup, mixing, near_dup, quality, sentencepiece_codec, sharding, toxicity
from lorekeep.llm.common import table

#: A public SentencePiece model; any other file can be given.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"

#: Words of a run of repeats from which op9 removes it: shorter ones are in most clean documents too.
OP9_WORDS = 20


def op1_ngram_ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return quality.quality(table(spark, sf_dir, "documents"), trusted)


def op2_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_merge_index_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_tfidf_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(licences.laid_out(table(spark, sf_dir, "documents")))


def op5_streaming_viterbi_pieces(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), sentencepiece_codec.read_model(model_path))


def op6_hyperminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.pages_through_archives(table(spark, sf_dir, "pages"))


def op8_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op9_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_spans(table(spark, sf_dir, "documents"), min_words=OP9_WORDS, sentences=True, stretches=True)


def op10_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_ratio_quality,
        op2_weak_supervision_toxicity,
        op3_merge_index_exact_dedup,
        op4_tfidf_licence_scan,
        op5_streaming_viterbi_pieces,
        op6_hyperminhash_near_dup,
        op7_arc_to_warc,
        op8_sainte_lague_mix,
        op9_line_hash_dedup,
        op10_prefix_sum_shards,
    )
}

#: Of equal texts the largest doc_id stays.
OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLES: dict[str, str] = {
    "op3_merge_index_exact_dedup": OP3_SQL,
}
