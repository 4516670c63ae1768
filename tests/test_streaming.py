from pyspark.sql import functions as F

from lodestone.streaming import changes as ch


def rows(spark, data):
    return spark.createDataFrame(data, "project_id long, file_path string, event_type string, t string").select("project_id", "file_path", "event_type", F.to_timestamp("t").alias("queued_at"))


DATA = [(1, "a", "modify", "2024-01-01 00:00:00"), (1, "a", "delete", "2024-01-01 00:00:00.3"), (1, "a", "modify", "2024-01-01 00:00:05"), (1, "b", "modify", "2024-01-01 00:00:01")]


def test_debounce_and_queue(spark):
    got = sorted((r.file_path, r.event_type, r.n_events) for r in ch.debounced(rows(spark, DATA)).collect())
    assert got == [("a", "delete", 2), ("a", "modify", 1), ("b", "modify", 1)]
    q = ch.coalesced(rows(spark, DATA))
    assert {(r.file_path, r.event_type) for r in q.collect()} == {("a", "modify"), ("b", "modify")}
    assert ch.oldest(q).collect()[0].file_path == "b"


def test_streams(spark, tmp_path):
    rows(spark, DATA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("project_id long, file_path string, event_type string, queued_at timestamp").parquet(str(tmp_path / "in"))
    s = ch.debounced(stream, watermark="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert spark.table("bursts").count() >= 2
    s = ch.keyed_queue(stream).writeStream.format("memory").queryName("queue").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert {(r.file_path, r.event_type) for r in spark.table("queue").collect()} == {("a", "modify"), ("b", "modify")}


def test_limits(spark):
    e = spark.createDataFrame([("u", i, f"2024-01-01 00:00:{i:02d}") for i in range(4)], "u string, event_id long, t string").withColumn("ts", F.to_timestamp("t"))
    got = [r.allowed for r in ch.limited(e, "u", 2, 4.0).orderBy("event_id").collect()]
    assert got == [True, True, True, False]
