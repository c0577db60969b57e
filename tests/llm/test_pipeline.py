"""The pipeline stage by stage."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_links, texts_of
from tributary.llm import decontamination


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        if name == "language":
            assert after.count() >= 0.99 * docs.count()
        if name == "near_duplicates":
            first = {c for c, _ in brute_links(texts_of(docs)).values()}
            assert {r.doc_id for r in after.collect()} == first
        if name == "decontamination":
            found = decontamination.with_contamination(spark, docs, spark.read.parquet(f"{data}/benchmark.parquet"))
            assert found.where(~decontamination.is_contaminated(F.col("contamination"))).count() == after.count()
        if name == "personal":
            assert after.count() == docs.count() and after.where(F.col("text").contains("@mail")).count() == 0
        if name == "pieces":
            assert after.count() == docs.count() and after.where("NOT lossless").count() == 0
        docs = after
