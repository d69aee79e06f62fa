"""A training corpus in five stages, from raw documents to token ids.

Each stage reads what the one before wrote, works on all of it, and its decisions take
effect: rejected documents go, of near duplicates one stays, repeated strings are cut
out, and every document comes as often as the mix takes it. The last stage returns
token ids.

Defined cases, for every stage: an empty table gives an empty result; input columns
beyond those of documents are dropped. Null, empty and short texts fail the quality rules.
Rows that repeat id and text go through the rules row by row, and the near-dedup keeps
one of them; rows of one id with other texts are documents of their own; rows without an
id pass the near-dedup as they are, so the suffix dedup cuts what they share with any
row. A text of which nothing is left has size 0, and the mix never takes it. A null
source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import mixing, neardup, pieces, quality, suffixes
from presswork.llm.common import materialise, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the vote of the quality rules keep."""
    return quality.quality_rules(docs).where("kept").select(*COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return neardup.deduplicated(docs, threshold=0.8).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes that also stand elsewhere."""
    out = suffixes.deduplicated(docs, length=400)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encode_texts(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Estimation, signatures and token ids are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
