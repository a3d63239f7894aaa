"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridstone.llm import decontaminate, language, lines, manifest, oracles, passages, personal, phrases, pieces, quality, sharding, simhash, toxicity, url_filter
from gridstone.llm.tables import documents, written

#: The contract's rules: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The public piece vocabulary; never copied into the repository.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(documents(spark, sf_dir), PIECE_MODEL)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    listed = written(url_filter.junk_urls(pages), "listed")
    return url_filter.judge(pages.drop("html"), RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_digest(documents(spark, sf_dir))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


def op10_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_digest(documents(spark, sf_dir))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.judged(documents(spark, sf_dir))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.document_manifest(documents(spark, sf_dir))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_pieces, op3_sharding, op4_url_filter, op5_lines, op6_passages, op7_simhash, op8_quality, op9_decontaminate, op10_personal, op11_language, op12_manifest, op13_phrases)}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; hashes, learned scores, sampling and fuzzy links are tested against plain versions instead."""
    return {"op4_url_filter": oracles.op4(RULES), "op8_quality": oracles.OP8, "op9_decontaminate": oracles.OP9, "op12_manifest": oracles.OP12, "op13_phrases": oracles.OP13}
