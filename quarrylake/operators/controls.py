"""Control questions over a property graph, answered in bulk and compared with what is expected; ordered snapshots of a graph.

Questions are rows, so thousands of them take the joins of one. Answers are compared as counted values: no question's answers
are gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.sources.sinks import canonical_json
from quarrylake.storage import stash

#: Forms of questions: names of the nodes that an edge leads from to a key; names on the way up from a named node over a path
#: of edges; keys of the nodes with a name; the number of nodes with a label.
FORMS = ("linked", "path", "key", "count")


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select("label", "key", F.col("properties")["name"].alias("name"))


def answers(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, value): one row for each answer to questions (id, form, label, subject, path).

    path is a list of edge types: the first is that of a linked question. label is that of the answer for linked questions, of
    the named node for path and key. A way that breaks off gives no answer, a node without a name none either, and a label
    without nodes the count 0. Of several nodes or ways each is an answer. A question of another form has none.
    """
    known, ask = _named(nodes), lambda form: questions.where(F.col("form") == form)
    linked = (
        ask("linked").select("id", "label", F.col("subject").alias("end_key"), F.get("path", F.lit(0)).alias("type"))
        .join(edges.select("type", "start_key", "end_key"), ["type", "end_key"]).join(known.withColumnRenamed("key", "start_key"), ["label", "start_key"])
        .where("name is not null").select("id", F.col("name").alias("value"))
    )
    by_name = known.withColumnRenamed("name", "subject")
    keys = ask("key").join(by_name, ["label", "subject"]).select("id", F.col("key").alias("value"))
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"))
    counts = ask("count").join(sizes, "label", "left").select("id", F.coalesce("n", F.lit(0)).cast("string").alias("value"))

    at = stash(ask("path").join(by_name, ["label", "subject"]).select("id", "path", "key", F.array().cast("array<string>").alias("names")), "control-paths")
    longest = at.agg(F.max(F.size("path"))).first()[0] or 0
    titles = known.select(F.col("key").alias("end_key"), "name")
    ended = at.where(F.size("path") <= 0)
    for step in range(longest):
        moved = at.where(F.size("path") > step).withColumn("type", F.get("path", F.lit(step))).withColumnRenamed("key", "start_key")
        reached = moved.join(edges.select("type", "start_key", "end_key"), ["type", "start_key"]).join(titles, "end_key")
        reached = reached.where("name is not null").select("id", "path", F.col("end_key").alias("key"), F.concat("names", F.array("name")).alias("names"))
        at = stash(reached, "control-paths")
        ended = ended.unionByName(at.where(F.size("path") == step + 1))
    ways = ended.where(F.size("names") > 0).select("id", F.array_join("names", " > ").alias("value"))
    return linked.unionByName(keys).unionByName(counts).unionByName(ways)


def differences(expected: DataFrame, given: DataFrame) -> DataFrame:
    """(id, value, expected, actual): how often each answer is expected and given. Nulls are equal to each other."""
    counted = lambda df, into: df.groupBy("id", "value").agg(F.count("*").alias(into))
    wanted, found = counted(expected, "expected"), counted(given, "actual")
    both = wanted.join(found, wanted["id"].eqNullSafe(found["id"]) & wanted["value"].eqNullSafe(found["value"]), "full_outer")
    return both.select(
        F.coalesce(wanted["id"], found["id"]).alias("id"), F.coalesce(wanted["value"], found["value"]).alias("value"),
        F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"),
    )


def results(questions: DataFrame, expected: DataFrame, given: DataFrame) -> DataFrame:
    """(id, passed, expected, actual, missing, unexpected) of each question: numbers of answers, repeats counted.

    A question passes if both have the same answers equally often, whatever their order; one without any on either side
    passes too. Answers to what was not asked count for nothing.
    """
    off = F.col("expected") - F.col("actual")
    told = differences(expected, given).groupBy("id").agg(
        F.sum("expected").alias("expected"), F.sum("actual").alias("actual"),
        F.sum(F.greatest(off, F.lit(0))).alias("missing"), F.sum(F.greatest(-off, F.lit(0))).alias("unexpected"),
    )
    whole = questions.select("id").distinct().join(told, "id", "left").fillna(0)
    return whole.select("id", ((F.col("missing") == 0) & (F.col("unexpected") == 0)).alias("passed"), "expected", "actual", "missing", "unexpected")


def snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Write a graph as canonical JSON lines below path, nodes by (label, key) and edges by (type, start_key, end_key).

    The files of each folder, in the order of their names, are sorted as a whole; properties are sorted by name. Returns
    (kind, rows, digest) of what was written: the digest sums the hashes of the lines read back, so it knows no order. An
    existing path is an error. An empty table gives 0 rows and a null digest.
    """
    spark, told = nodes.sparkSession, None
    properties: Column = F.map_from_entries(F.array_sort(F.map_entries("properties")))
    parts = {"nodes": (nodes.select("label", "key", properties.alias("properties")), ["label", "key"]), "edges": (edges.select("type", "start_key", "end_key"), ["type", "start_key", "end_key"])}
    for kind, (rows, order) in parts.items():
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        placed.select(canonical_json(rows, rows.columns).alias("value")).write.text(f"{path}/{kind}")
        lines = spark.read.text(f"{path}/{kind}").agg(F.count("*").alias("rows"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string").alias("digest"))
        part = lines.select(F.lit(kind).alias("kind"), "rows", "digest")
        told = part if told is None else told.unionByName(part)
    return told
