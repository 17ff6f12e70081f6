"""Telemetry streams: envelopes, replay-safe deduplication, latest values, windows and incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.storage import scratch_path


def envelope(points: DataFrame) -> DataFrame:
    """points (tag, measured_at, value, unit) with status and missing_fields; a null value is present, an absent unit is not."""
    gaps = F.filter(F.array(F.when(F.col("unit").isNull(), F.lit("unit")), F.when(F.col("measured_at").isNull(), F.lit("measured_at"))), lambda x: x.isNotNull())
    return points.withColumn("missing_fields", gaps).withColumn("status", F.when(F.size(gaps) > 0, "incomplete").otherwise("ok"))


def deduplicated(points: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Points without replays of the same tag, time and point."""
    return points.withWatermark("measured_at", delay).dropDuplicatesWithinWatermark(["tag", "measured_at", "point_id"])


def windows(points: DataFrame, width: str = "1 day") -> DataFrame:
    """Number of points, of gaps, and the mean value of each tag in tumbling windows."""
    grouped = points.groupBy("tag", F.window("measured_at", width).alias("w"))
    found = grouped.agg(F.count("*").alias("points"), F.count(F.when(F.col("value").isNull(), 1)).alias("gaps"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("total"))
    return found.select("tag", F.col("w.start").alias("window_start"), "points", "gaps", "total")


def latest(points: DataFrame) -> DataFrame:
    """The last value of each tag by time, then point; null and zero are kept."""
    return points.groupBy("tag").agg(F.max_by(F.struct("value", "measured_at", "point_id"), F.struct("measured_at", "point_id")).alias("last")).select("tag", "last.value", "last.measured_at", "last.point_id")


def run_available(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream over what is there and read its result from the shared folder. Complete output replaces the one before;
    appended output has a folder for each batch, which a repeated batch replaces, so rows are kept once. A stream without
    input gives an empty result."""
    spark: SparkSession = stream.sparkSession
    out, marks = scratch_path(spark, label), scratch_path(spark, f"{label}-marks")

    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/first")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'whole' if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def split_by_status(points: DataFrame, good: str, bad: str, marks: str):
    """A streaming query that writes sound envelopes below one path and all others below another, a folder for each batch;
    a repeated batch replaces its folders."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.where("status = 'ok'").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("status <> 'ok'").write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return envelope(points).writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start()


def sliding(points: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    """Number of points, of gaps, and the mean value by well and tag in sliding windows of a stream in append mode: a window
    is given once, when it ended more than delay before the newest point so far. A point that comes later than that for
    a window is dropped from it; for windows that are still open it counts."""
    grouped = points.withWatermark("measured_at", delay).groupBy("well", "tag", F.window("measured_at", width, slide).alias("w"))
    found = grouped.agg(F.count("*").alias("points"), F.count(F.when(F.col("value").isNull(), 1)).alias("gaps"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("total"))
    return found.select("well", "tag", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "points", "gaps", "total")


def append(stream: DataFrame, path: str, marks: str) -> None:
    """Run a stream over what is new since the run before with the checkpoint marks, and add its rows to path: a folder for
    each batch, which a repeated batch replaces. Read it back with appended()."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows that append() added to path."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def append_once(stream: DataFrame, key: str, path: str, marks: str) -> None:
    """append() for rows whose key no earlier row had, in this run or one before: what is known is the stream's state in its
    checkpoint, on disk where the state is kept, so a batch costs what the batch has and not what the index has. The state
    has the keys alone and grows with the index; marks must live as long as path does."""
    conf, setting = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(setting)
    conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        append(stream.dropDuplicates([key]), path, marks)
    finally:
        conf.set(setting, before)
