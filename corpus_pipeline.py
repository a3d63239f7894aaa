"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination and encoding of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm import decontaminate, lines, pieces, simhash, toxicity
from gridstone.llm.queries import PIECE_MODEL
from gridstone.llm.tables import discard, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of alike lines the first stays; texts shrink, no document goes, and n_chars follows the text."""
    out = lines.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    found = decontaminate.judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("not contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the pieces of one sampled segmentation, with whether they decode to the text."""
    return pieces.encode(docs, PIECE_MODEL).select("doc_id", "lang", "source", "n_chars", "pieces", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pieces", encode),
]

#: SQL cannot express fingerprints, learned scores or sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
