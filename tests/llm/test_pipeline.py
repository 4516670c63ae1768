from pyspark.sql import functions as F

import corpus_pipeline


from .fixtures import documents


def test_stages_on_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[1:]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        if name != "packing":
            assert docs.columns == before.columns
        if name == "near_duplicates":
            left = [r.doc_id for r in docs.collect()]
            assert sum(100 <= (i or 0) < 300 for i in left) == 1 and {0, 1, 303, 304} <= set(left)
    assert docs.count() > 0


def test_whole_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:4] == ["doc_id", "start", "length", "ids_crc32"]
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.where("n > 1024").count() == 0 and out.count() > 100


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
