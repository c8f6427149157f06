"""The registered queries against reference SQL, and the pipeline against its parts."""

import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert_same(df, connect(sf_dir), ORACLES[name])
    else:
        assert df.count() > 0


def test_pipeline_stages(spark, sf_dir, tmp_path):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("kept"))
    docs, columns = before, before.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or name == "packing"
    counts = {n: spark.read.parquet(str(tmp_path / n)).count() for n, _ in corpus_pipeline.STAGES[:-1]}
    assert before.count() > counts["quality"] > counts["near_dedup"] >= counts["decontaminate"] == counts["secrets"]
    packed = docs.groupBy("doc_id").agg(F.sum("length")).count()
    assert packed == spark.read.parquet(str(tmp_path / "secrets")).select("doc_id").distinct().count()


def test_run_equals_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(rows.columns) and rows.count() > 0
