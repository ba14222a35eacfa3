"""A corpus pipeline of five stages; each reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placemill.llm import exact_dedup, mixing, quality, sentencepieces, shingles
from placemill.llm.common import read_table, written
from placemill.llm.queries import tokenizer_path

#: Words of a shingle in the near-duplicate stage, and the similarity of shingle sets at which it links; the operator's own query takes three words and two bits.
NEAR_WORDS = 5
NEAR_LEAST = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest stays."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, those whose sets of five-word shingles have a similarity of 0.8 or more, stays."""
    return shingles.keep_one(docs, NEAR_WORDS, NEAR_LEAST)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them."""
    return mixing.mixed(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return sentencepieces.digests(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("mixing", mix_stage),
    ("sentencepiece", encode_stage),
]

#: The classifier is fitted in floating point and the mix draws by hash, neither of which SQL expresses.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
