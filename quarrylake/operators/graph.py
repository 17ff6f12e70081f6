"""Property-graph tables: nodes (label, key, properties) and edges (type, start_key, end_key), and jobs over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.storage import discard, stash


def nodes_from(df: DataFrame, label: str, key: Column, properties: dict[str, Column]) -> DataFrame:
    """One node for each row; properties that are null are left out of the map."""
    pairs = [F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in properties.items()]
    kept = F.map_from_entries(F.filter(F.array(*pairs).cast("array<struct<key:string,value:string>>"), lambda p: p["value"].isNotNull()))
    return df.select(F.lit(label).alias("label"), key.cast("string").alias("key"), kept.alias("properties"))


def edges_from(df: DataFrame, kind: str, start: Column, end: Column) -> DataFrame:
    """Distinct edges between two key columns; rows without either end make none."""
    found = df.select(F.lit(kind).alias("type"), start.cast("string").alias("start_key"), end.cast("string").alias("end_key"))
    return found.where("start_key is not null and end_key is not null").distinct()


def first_wins(df: DataFrame, keys: list[str], order: list[str], content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key in order, (keys, seen, duplicates, conflicting)): later equal rows are duplicates, later rows
    with other content conflict. Nulls are equal to each other. Aggregates combine before the shuffle, so a key that many rows
    share is never gathered."""
    digest = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in content))
    held = df.groupBy(*keys).agg(
        F.min_by(F.struct(*df.columns), F.struct(*order, digest.alias("__digest"))).alias("__first"),
        F.count("*").alias("seen"), F.min(digest).alias("__low"), F.max(digest).alias("__high"),
    )
    report = held.select(*keys, "seen", (F.col("seen") - 1).alias("duplicates"), (F.col("__low") != F.col("__high")).alias("conflicting"))
    return held.select("__first.*"), report


def resolve_edges(edges: DataFrame, nodes: DataFrame, start_label: str, end_label: str) -> tuple[DataFrame, DataFrame]:
    """(accepted edges, issues): both ends must exist with the expected labels. A reason names the first failure."""
    known = nodes.select("label", "key").distinct()
    start = known.select(F.col("key").alias("start_key"), F.col("label").alias("start_label"))
    end = known.select(F.col("key").alias("end_key"), F.col("label").alias("end_label"))
    reason = (
        F.when(F.col("start_label").isNull(), "dangling_start").when(F.col("end_label").isNull(), "dangling_end")
        .when((F.col("start_label") != start_label) | (F.col("end_label") != end_label), "wrong_label")
    )
    judged = edges.join(start, "start_key", "left").join(end, "end_key", "left").withColumn("reason", reason)
    columns = ["type", "start_key", "end_key"]
    return judged.where("reason is null").select(*columns), judged.where("reason is not null").select(*columns, "reason")


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes after an idempotent upsert, with outcome created, matched or kept: new properties overwrite, others stay."""
    a, b = old.select("key", F.col("label").alias("l0"), F.col("properties").alias("p0")), new.select("key", F.col("label").alias("l1"), F.col("properties").alias("p1"))
    merged = F.when(F.col("p0").isNull(), F.col("p1")).when(F.col("p1").isNull(), F.col("p0")).otherwise(F.map_concat(F.map_filter("p0", lambda k, _: ~F.map_contains_key("p1", k)), F.col("p1")))
    outcome = F.when(F.col("l0").isNull(), "created").when(F.col("l1").isNull(), "kept").otherwise("matched")
    return a.join(b, "key", "full_outer").select(F.coalesce("l1", "l0").alias("label"), "key", merged.alias("properties"), outcome.alias("outcome"))


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges after an idempotent upsert; new edges need both ends among the nodes."""
    keys = nodes.select("key").distinct()
    sound = new.distinct().join(keys.withColumnRenamed("key", "start_key"), "start_key", "left_semi").join(keys.withColumnRenamed("key", "end_key"), "end_key", "left_semi")
    columns = ["type", "start_key", "end_key"]
    created = sound.join(old, columns, "left_anti").select(*columns, F.lit("created").alias("outcome"))
    return old.join(sound, columns, "left_semi").select(*columns, F.lit("matched").alias("outcome")).unionByName(created).unionByName(old.join(sound, columns, "left_anti").select(*columns, F.lit("kept").alias("outcome")))


def hop(start: DataFrame, edges: DataFrame, kind: str, at: str, into: str) -> DataFrame:
    """start with the key reached from column at over edges of a type, one row for each."""
    step = edges.where(F.col("type") == kind).select(F.col("start_key").alias(at), F.col("end_key").alias(into))
    return start.join(step, at)


def normalize_id(c: Column) -> Column:
    """Trim, percent-decode and drop one trailing colon; a text that cannot be decoded stays as it is. A plus is a plus."""
    trimmed = F.trim(c)
    return F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(trimmed, F.lit("+"), F.lit("%2B"))), trimmed), ":$", "")


def parse_id(c: Column) -> dict[str, Column]:
    """Partition, group, type and record of a record id like part:group--Type:record; all null if it has another form."""
    form = r"^([\w.-]+):([\w-]+)--([A-Za-z]+):(.+)$"
    return {name: F.when(c.rlike(form), F.regexp_extract(c, form, k)) for k, name in enumerate(("partition", "group", "type", "record"), 1)}


def surrogate_key(*parts: Column) -> Column:
    """sha256 of the compact JSON list of the parts as text."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 256)


def parent_cycles(parents: DataFrame, rounds: int = 60) -> DataFrame:
    """(key) of the rows of (key, parent) that never reach a root: they stand on a cycle of parents or below one.

    Every round doubles the distance that a row looks up, so a hierarchy of depth n takes log2(n) joins; rows that reached
    a root, a null parent or one that is no key, drop out. Of repeated keys the smallest parent counts.
    """
    step = stash(parents.where("key is not null").groupBy("key").agg(F.min("parent").alias("parent")), "parents")
    total = step.count()
    for done in range(1, rounds + 1):
        above = step.select(F.col("key").alias("parent"), F.col("parent").alias("next"))
        climbed = stash(step.join(above, "parent").where("next is not null").select("key", F.col("next").alias("parent")), "parents")
        discard(step)
        step = climbed
        if 2**done > total or step.isEmpty():
            break
    return step.select("key")
