"""The queries of this subpackage and their SQL: one per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm import exact_dedup, infill, interpolation, media, merkle, mixing, personal, quality, sentencepieces, simhash, toxicity, warc, wrappers
from placemill.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.assign(read_table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.decode(media.encode(read_table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest_rows(warc.round_trip(read_table(spark, sf_dir, "pages")))


def op6_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(read_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", F.col("copies"))


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(read_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_simhash": op2_simhash,
        "op3_media": op3_media,
        "op4_quality": op4_quality,
        "op5_warc": op5_warc,
        "op6_interpolation": op6_interpolation,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_wrappers": op9_wrappers,
        "op10_mixing": op10_mixing,
        "op11_personal": op11_personal,
        "op12_merkle": op12_merkle,
        "op13_infill": op13_infill,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.ORACLE_SQL, "op7_exact_dedup": exact_dedup.ORACLE_SQL, "op12_merkle": merkle.ORACLE_SQL, "op13_infill": infill.ORACLE_SQL}
