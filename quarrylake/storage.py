"""Reading the input tables and keeping intermediate results where every executor can see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data set directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: the session's spark.checkpoint.dir.

    Only a local session without that setting (a test) gets a fresh temporary folder of its own. Elsewhere executors would each
    write to their own disk, so a session without it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarrylake-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str, file_rows: int | None = None, codec: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors. file_rows is the
    most rows of a file, for rows of which a reader cannot hold many.

    Unlike DataFrame.checkpoint() the plan runs once, and the result is columnar and prunable.
    """
    path = scratch_path(df.sparkSession, label)
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind stashed frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
