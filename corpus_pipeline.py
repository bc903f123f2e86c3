"""A cleaning pipeline over documents, and all queries of the corpus operators.

Each stage takes what the one before kept, written as Parquet and read again. Rejected texts, copies,
near copies and documents with benchmark passages go; the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailfleet.llm import bpe, quality
from mailfleet.llm.decontaminate import decontaminated
from mailfleet.llm.exact import without_copies
from mailfleet.llm.jaccard import one_of_each_group
from mailfleet.llm.queries import ORACLES as OPERATOR_ORACLES
from mailfleet.llm.queries import QUERIES as OPERATORS
from mailfleet.llm.queries import table, tokenizer
from mailfleet.llm.shared import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels, does not reject (score 0.3 or more)."""
    slim = docs.select("doc_id", F.col("text").alias("_text"))
    return quality.accepted(docs, quality.learn(slim, table(spark, sf_dir, "labels")), 0.3)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the least id."""
    return without_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, the one with the least id."""
    return one_of_each_group(docs, size=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


#: Text that the encoder holds at a time, beside what the stages before left in the workers.
BATCH_BYTES = 1 << 20


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: the byte-level BPE ids of each document, and the digest of the bytes they decode to."""
    import public_tokenizers

    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, batch_bytes=BATCH_BYTES, with_round_trip=True)


#: Texts that a writer holds before it puts them down.
ROW_GROUP_BYTES = 16 << 20

STAGES = [
    ("quality", good_quality), ("exact_dedup", no_copies), ("near_dedup", no_near_copies),
    ("decontamination", no_benchmark), ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", ROW_GROUP_BYTES)
    return docs


#: A learned classifier has no SQL; the stages are tested against brute force.
ORACLE_SQL = None
QUERIES = {**OPERATORS, "pipeline": run}
ORACLES = {**OPERATOR_ORACLES, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
