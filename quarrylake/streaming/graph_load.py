"""A property graph kept up to date from streams: each micro-batch is added once, and reading merges what was added."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylake.sources import publish

CHANGES = "label string, key string, at long, name string, value string"
EDGES = "type string, start_key string, end_key string"


def _state(spark: SparkSession, path: str) -> dict:
    text = publish.read_text(spark, f"{path}/{publish.MARKER}")
    held = json.loads(text) if text else {"owner": publish.OWNER, "schema_version": publish.SCHEMA_VERSION, "kind": "graph", "last": {}, "parts": []}
    if held.get("owner") != publish.OWNER or held.get("kind") != "graph":
        raise publish.Refused("NOT_OWNED", [("marker of another owner", 1)])
    return held


def _latest(changes: DataFrame) -> DataFrame:
    """For each node and property the value that was set last; at one time, the greater value. A node without properties has
    a row whose name is null. Aggregates combine before the shuffle, so a node that very many rows set is no hot spot."""
    newest = changes.groupBy("key", "name").agg(F.max(F.struct("at", "value", "label")).alias("m"))
    return newest.select("m.label", "key", "m.at", "name", "m.value")


def changes(nodes: DataFrame) -> DataFrame:
    """(label, key, at, name, value) from nodes (label, key, properties, at); null keys are left out, null values are not set."""
    held = nodes.where("key is not null")
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    entries = F.concat(none, F.filter(F.map_entries("properties"), lambda e: e["value"].isNotNull()))
    rows = held.select("label", "key", "at", F.explode(F.coalesce(entries, none)).alias("e"))
    return _latest(rows.select("label", "key", F.col("at").cast("long").alias("at"), F.col("e.key").alias("name"), F.col("e.value").alias("value")))


def add(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame, source: str, number: int) -> bool:
    """Add batch number of a source to the graph at path; False if that batch is there already, which changes nothing.

    nodes has (label, key, properties, at), edges (type, start_key, end_key). A batch is written to a folder of its own and
    counts from the moment when the marker names it, nodes and edges together; a batch that broke off is written anew. The
    work grows with the batch, not with the graph.
    """
    state = _state(spark, path)
    if number <= state["last"].get(source, -1):
        return False
    part = f"parts/{source}-{number}"
    changes(nodes).write.mode("overwrite").parquet(f"{path}/{part}/nodes")
    sound = edges.where("start_key is not null and end_key is not null").select("type", "start_key", "end_key").distinct()
    sound.write.mode("overwrite").parquet(f"{path}/{part}/edges")
    state["last"][source] = number
    publish.write_text(spark, f"{path}/{publish.MARKER}", publish.canonical_json(state | {"parts": [*state["parts"], part]}))
    return True


def load(stream: DataFrame, to_nodes: Callable[[DataFrame], DataFrame], to_edges: Callable[[DataFrame], DataFrame], path: str, source: str, marks: str) -> StreamingQuery:
    """A started query that adds each micro-batch of what is there now to the graph at path; see add(). marks is its checkpoint."""

    def keep(batch: DataFrame, number: int) -> None:
        add(batch.sparkSession, path, to_nodes(batch), to_edges(batch), source, number)

    return stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start()


def _parts(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    parts = _state(spark, path)["parts"]
    return spark.read.schema(schema).parquet(*(f"{path}/{p}/{kind}" for p in parts)) if parts else spark.createDataFrame([], schema)


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, pending): nodes (label, key, properties) with the value of each property that was set last, whatever
    batch brought it; edges whose both ends are nodes; edges that wait for an end. However the rows are cut into batches, the
    tables are the same."""
    newest = _latest(_parts(spark, path, "nodes", CHANGES))
    pair = F.when(F.col("name").isNotNull(), F.struct("name", "value"))
    nodes = newest.groupBy("key").agg(F.max(F.struct("at", "label"))["label"].alias("label"), F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("properties"))
    nodes = nodes.select("label", "key", "properties")
    edges, keys = _parts(spark, path, "edges", EDGES).distinct(), nodes.select("key")
    ends = lambda c: keys.withColumnRenamed("key", c)
    both = edges.join(ends("start_key").withColumn("has_start", F.lit(True)), "start_key", "left").join(ends("end_key").withColumn("has_end", F.lit(True)), "end_key", "left")
    whole = F.col("has_start").isNotNull() & F.col("has_end").isNotNull()
    columns = ["type", "start_key", "end_key"]
    return nodes, both.where(whole).select(*columns), both.where(~whole).select(*columns)


def compact(spark: SparkSession, path: str) -> int:
    """Replace all parts by one, so that reading stays fast; returns how many there were. Values keep the time they were set
    at, pending edges stay, and batches that were added before are still known. Old folders go after the marker is replaced."""
    state = _state(spark, path)
    if len(state["parts"]) < 2:
        return len(state["parts"])
    part = f"parts/whole-{uuid.uuid4().hex}"
    _latest(_parts(spark, path, "nodes", CHANGES)).write.parquet(f"{path}/{part}/nodes")
    _parts(spark, path, "edges", EDGES).distinct().write.parquet(f"{path}/{part}/edges")
    publish.write_text(spark, f"{path}/{publish.MARKER}", publish.canonical_json(state | {"parts": [part]}))
    for old in state["parts"]:
        publish._delete(spark, f"{path}/{old}")
    return len(state["parts"])
