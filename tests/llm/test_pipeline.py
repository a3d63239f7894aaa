"""The pipeline's stages on small data: columns, decisions and what stays."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline
import pytest
from gridstone.llm import queries
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows by name."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(at)
        found = spark.read.parquet(at)
        out[name] = docs, found
        docs = found
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(spark, stages):
    want = spark.read.parquet(f"{DATA}/documents.parquet").dtypes
    for name, (_, found) in stages.items():
        if name != "pieces":
            assert found.dtypes == want, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "pieces"]


def test_toxicity(spark, stages):
    docs, found = stages["toxicity"]
    flagged = {r.doc_id for r in queries.op1_toxicity(spark, DATA).collect() if r.predicted}
    assert set(rows(found)) == set(rows(docs)) - flagged


def test_lines(stages):
    docs, found = map(rows, stages["line_dedup"])
    assert set(docs) == set(found)
    for k, r in found.items():
        left, own = r.text.split("\n") if r.text else [], docs[k].text.split("\n")
        rest = iter(own)
        assert all(x in rest for x in left) and r.n_chars == len(r.text)
    assert any(found[k].text != docs[k].text for k in docs)


def test_near_duplicates(stages):
    docs, found = map(rows, stages["near_duplicates"])
    own = sorted((k, r.text) for k, r in docs.items())
    assert {str(k) for k in found} == {c for _, _, c in brute.simhash(own)}


def test_decontamination(spark, stages):
    docs, found = map(rows, stages["decontamination"])
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert set(found) == {k for k, r in docs.items() if not brute.contamination(r.text, items)[4]}


def test_pieces(stages):
    docs, found = stages["pieces"]
    assert found.count() == docs.count() and found.filter("not lossless").count() == 0


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, DATA).select("doc_id", F.xxhash64("pieces").alias("h")).collect()
    want = stages["pieces"][1].select("doc_id", F.xxhash64("pieces").alias("h")).collect()
    assert sorted(out) == sorted(want)


def test_odd_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "x", "en", None, 1), (5000, "", None, "s", 0), (5000, "", None, "s", 0), (5001, None, "en", "s", None)], docs.schema)
    for some in (docs.unionByName(odd), docs.filter("false"), odd):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, DATA)
        some.collect()
