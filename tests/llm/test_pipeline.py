"""The stages on the smallest tables: each against the operator's own decision, columns and order."""

from pyspark.sql import functions as F

import corpus_pipeline
from scholia.llm import decontaminate, near_dedup, toxicity

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{DIR}/labels.parquet"))
            gone = {r[0] for r in toxicity.score(before, model).filter("predicted = 1").select("doc_id").collect()}
            assert {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in docs.select("doc_id").collect()} == gone
        if name == "line_dedup":
            assert docs.count() == before.count() and docs.filter(F.length("text") != F.col("n_chars")).count() == 0
            lines = [x for r in docs.select("text").collect() for x in r[0].split("\n") if len(x.strip()) >= 10]
            assert len(lines) == len(set(lines))
        if name == "near_dedup":
            assert near_dedup.near_duplicates(docs).filter("doc_id != class_id").count() == 0
        if name == "decontamination":
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).count() == 0
        if name == "packing":
            assert docs.select("doc_id").distinct().count() == before.count()
