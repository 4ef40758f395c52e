"""A training-data pipeline over ``documents``: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's result to the shared folder and
reads it back as the next one's documents. A null text is no language and goes in the first stage; a null doc_id is carried
through; repeated rows of one document end as one row after near-dedup; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from regrowth.llm import chunked_bpe, decontaminate, language_id, near_copies, pii, simhash
from regrowth.llm.common import ship, table
from regrowth.session import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the classifier knows go."""
    ship(spark)
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of five-word shingles of 0.8 or more the one with the smallest id (then text hash) stays."""
    ship(spark)
    return simhash.keep_one(docs, near_copies.near_copies(docs))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified overlap with a benchmark item go."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind; n_chars follows."""
    ship(spark)
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their digests, and the digest of the decoded bytes."""
    ship(spark)
    return chunked_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("PII", redact_personal_data),
    ("byte-level BPE", encode),
]

#: No SQL: the classifiers and the tokenizer have none. ``tests/llm/test_pipeline.py`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{i + 1}")
    return docs
