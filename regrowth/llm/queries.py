"""Named queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from regrowth.llm import chunked_bpe, decontaminate, fill_middle, language_id, language_model, periodic_runs, pii, quality_rules, separator_scan, sharding, simhash, suffix_dedup, token_files
from regrowth.llm.common import table

SHARDS = 40


def op1_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside fold 0."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_byte_position_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_hierarchical_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from the documents outside fold 0."""
    return language_model.learn_and_score(table(spark, sf_dir, "documents"))


def op4_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the rank file, and decoded."""
    return chunked_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards by its id."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found by scanning flat token files for separators."""
    return separator_scan.document_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50256)


def op7_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and added spans of personal data of every document."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified overlaps between documents and benchmark items; documents without any have no row."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to directly addressable files in id order, and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rule and the learned decision list's verdict for every document."""
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_difference_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, one in ten of which gets a repetition planted first."""
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def op12_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that occur more than once in all documents."""
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op13_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rewritten for filling in its middle, or left plain, by draws from its id."""
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_string_kernel": op1_string_kernel,
    "op2_byte_position_simhash": op2_byte_position_simhash,
    "op3_hierarchical_pitman_yor": op3_hierarchical_pitman_yor,
    "op4_chunked_bpe": op4_chunked_bpe,
    "op5_jump_sharding": op5_jump_sharding,
    "op6_separator_scan": op6_separator_scan,
    "op7_candidate_boosting": op7_candidate_boosting,
    "op8_spaced_seeds": op8_spaced_seeds,
    "op9_addressable_codes": op9_addressable_codes,
    "op10_decision_list": op10_decision_list,
    "op11_difference_cover_runs": op11_difference_cover_runs,
    "op12_two_stage_suffixes": op12_two_stage_suffixes,
    "op13_content_chunks": op13_content_chunks,
}
ORACLES: dict[str, str] = {}
