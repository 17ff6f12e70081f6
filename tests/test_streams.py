"""Streams that drop what is too late, and add what they have seen before only once."""

from pyspark.sql import functions as F

from quarrylake.storage import scratch_path
from quarrylake.streaming import telemetry

SCHEMA = "well string, tag string, measured_at timestamp, value double"


def test_sliding_windows_drop_late_rows(spark):
    landed, path, marks = (scratch_path(spark, x) for x in ("landed", "windows", "marks"))
    at = lambda h, m=0: f"2024-01-01 {h:02}:{m:02}:00"
    parts = [
        [("a", "p", at(1), 1.0), ("a", "p", at(1, 30), None), ("b", "p", at(1), 5.0)],
        [("a", "p", at(6), 2.0)],
        [("a", "p", at(1, 45), 100.0), ("a", "p", at(5, 10), 3.0), ("a", "p", at(12), 4.0)],  # 1:45 is too late for all its windows, 5:10 for none
    ]
    for part in parts:
        spark.createDataFrame([(w, t, a, v) for w, t, a, v in part], "well string, tag string, at string, value double").withColumn("measured_at", F.to_timestamp("at")).select("well", "tag", "measured_at", "value").write.mode("append").parquet(landed)
        found = telemetry.sliding(spark.readStream.schema(SCHEMA).parquet(landed), "2 hours", "1 hour", "1 hour")
        telemetry.append(found, path, marks)
    rows = telemetry.appended(spark, path, found.schema).select("well", F.hour("window_start").alias("h"), "points", "gaps", "total").collect()
    expected = {
        ("a", 0, 2, 1, 1.0), ("a", 1, 2, 1, 1.0), ("b", 0, 1, 0, 5.0), ("b", 1, 1, 0, 5.0),
        ("a", 4, 1, 0, 3.0), ("a", 5, 2, 0, 5.0), ("a", 6, 1, 0, 2.0),
    }
    assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)


def test_append_once_over_runs(spark):
    landed, path, marks = (scratch_path(spark, x) for x in ("landed", "index", "marks"))
    sizes = []
    for ids in (["a", "b", "a"], ["b", "c", "c"], [], ["a", "b", "c", "d"]):
        spark.createDataFrame([(i, f"text {i}") for i in ids], "fragment_id string, text string").write.mode("append").parquet(landed)
        stream = spark.readStream.schema("fragment_id string, text string").parquet(landed)
        telemetry.append_once(stream, "fragment_id", path, marks)
        sizes.append(telemetry.appended(spark, path, "fragment_id string, text string").count())
    assert sizes == [2, 3, 3, 4]
    assert sorted(tuple(r) for r in telemetry.appended(spark, path, "fragment_id string, text string").collect()) == [(i, f"text {i}") for i in "abcd"]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
