"""SimHash near-duplicates of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.bitsliced import links_within
from gridstone.llm.components import components
from gridstone.llm.tables import prepare, written

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Shingles counted at once, so that bits of very long texts stay in bounded memory.
COUNT_ROWS = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64; 0 without words.

    A-Z are lower-cased, words are what ASCII white space parts, repeats
    count, and a text with fewer words is one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.append(0, ends[: len(words) - k] + 1).tolist()
    digest, seed = xxhash.xxh64_digest, SEED
    hashed = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashed, dtype=np.uint8).reshape(-1, 8)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), COUNT_ROWS):
        total += np.unpackbits(rows[at : at + COUNT_ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(rows)).tobytes(), "big")


def _fingerprints(texts: pa.Array) -> pa.Array:
    found = np.fromiter((fingerprint(t) for t in texts.to_pylist()), dtype=np.uint64, count=len(texts))
    return pa.array(found.view(np.int64))


def _with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.withColumn(name, F.arrow_udf(_fingerprints, "bigint")("text"))


def component_labels(made: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root and component_id for each distinct fingerprint of ``made`` (doc_id, fp)."""
    nodes = written(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links_within(nodes, radius, nodes.count()))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(names, "root")


def with_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (the fingerprint as bigint), root and component_id of each row.

    Texts are read once and never shuffled. Links join fingerprints with at
    most ``radius`` differing bits; equal fingerprints are one node, so groups
    of copies cost one comparison. component_id is the least doc_id of the
    component. Null texts and texts without words have fingerprint 0 and are
    linked like any other. Repeated rows stay; a component_id is null only if
    all its ids are.
    """
    made = written(_with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), "fingerprints")
    return made.join(component_labels(made, radius), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    found = with_components(docs, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the least doc_id.

    With unique ids only those to drop meet the texts. Where ids repeat or are
    null, rows are told apart by id (null last) and text instead.
    """
    found = written(with_components(docs, radius), "components")
    n, ids = found.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        drop = found.filter("doc_id != component_id").select(F.col("doc_id").alias("__gs_id"))
        return docs.join(drop, F.col("doc_id") == F.col("__gs_id"), "left_anti")
    labels = found.select("fp", "root").distinct().select(F.col("fp").alias("__gs_f"), F.col("root").alias("__gs_root"))
    keyed = _with_fingerprint(docs, "__gs_fp").join(labels, F.col("__gs_fp") == F.col("__gs_f"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    best = keyed.groupBy("__gs_root").agg(F.min(place).alias("__gs_best")).withColumnRenamed("__gs_root", "__gs_r")
    kept = keyed.join(best, (F.col("__gs_root") == F.col("__gs_r")) & place.eqNullSafe(F.col("__gs_best")))
    return kept.dropDuplicates(["__gs_root"]).select(*docs.columns)
