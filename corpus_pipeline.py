"""From raw documents to sampled token ids, in five stages; each stage's rows are written and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm import minhash, mixing, pieces, quality, secrets
from assayloom.llm.store import saved


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, fitted on the labelled documents of its input: the documents that it rejects go. Null and empty texts score by the
    classifier's bias; very long ones are scored whole; a score of just the cut is accepted, and repeated rows score alike; without usable labels, or without
    documents, nothing goes."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, five-word shingles at 0.8: one document of each group stays, that of the smallest id. Null and empty texts are like
    nothing and stay; of rows that repeat an id one stays, that of the text which sorts first; rows without an id stay. Sets of very long texts are compared whole."""
    return minhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: secrets give way to a mark and n_chars is counted anew; no document goes. Null and empty texts stay as they are; very long
    ones are scanned whole; of secrets that overlap the earlier is marked first, and the mark covers both; repeated rows change alike."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents as often as the mix takes them. Null and empty texts have no words, so the mix has none of them; repeated
    rows are documents of their own; a null source is a source; documents of any length are taken whole, as often as their taken words over
    their size, rounded half up. Quotas that tie go to the source, then the shard, that sorts first."""
    return mixing.mixed_documents(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: doc_id, source, and the sampled piece ids of each document with their number (null text: 0). Copies of a document that
    the mix took twice, and rows that repeat an id and text, share a row key, and so their pieces. Very long texts are encoded whole, chunk by chunk."""
    encoded = pieces.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), without=("text",))
    return encoded.select("doc_id", "source", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", sample_pieces),
]

#: Learnt weights, seeded hashes and sampling have no SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each works on all that the one before kept, written as Parquet and read again. Columns of
    documents beyond the usual ones pass through all stages but the last. An empty table gives an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
