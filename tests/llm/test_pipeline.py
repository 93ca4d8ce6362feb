import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs.count()
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(pipeline.STAGES):
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert 0 < docs.count() <= seen and docs.select("doc_id").distinct().count() == docs.count()
            seen = docs.count()
        else:
            assert out.select("doc_id").distinct().count() == seen
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_run_gives_what_the_stages_give(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    key = lambda df: {(r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect()}
    assert key(pipeline.run(spark, sf_dir)) == key(pipeline.packing_stage(spark, docs, sf_dir))


def test_copies_and_benchmark_passages_go(spark, sf_dir, tmp_path):
    good = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id").orderBy("doc_id").limit(30)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    leaky = good.limit(1).select(F.lit(10**6).alias("doc_id"), F.concat("text", F.lit("\n"), F.lit(item)).alias("text"), "lang", "source", "n_chars")
    kept = pipeline.benchmark_stage(spark, good.select(pipeline.COLUMNS).unionByName(leaky.select(good.select(pipeline.COLUMNS).columns)), sf_dir)
    assert 10**6 not in {r[0] for r in kept.select("doc_id").collect()}
    copies = good.select(pipeline.COLUMNS).unionByName(good.limit(5).select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "lang", "source", "n_chars"))
    left = {r[0] for r in pipeline.near_stage(spark, copies, sf_dir).select("doc_id").collect()}
    assert not any(i >= 10**6 for i in left)


def test_awkward_rows(spark, docs, sf_dir):
    for _, stage in pipeline.STAGES[1:]:
        stage(spark, docs.select(pipeline.COLUMNS), sf_dir).collect()
        stage(spark, docs.select(pipeline.COLUMNS).where("false"), sf_dir).collect()
