"""Publication archives: candidates, duplicates, decisions and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators.components import connected_components
from quarrylake.storage import stash


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, without a fragment; the query stays."""
    bare = F.regexp_replace(F.trim(c), "#.*$", "")
    head = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def domain_matches(host_: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    fits = F.lit(False)
    for d in domains:
        fits = fits | (host_ == d) | F.endswith(host_, F.lit(f".{d}"))
    return fits


def audit(records: DataFrame, start: str, end: str, matches: Column) -> DataFrame:
    """records with status: outside_period, then insufficient_evidence for missing text, url or source, then candidate or
    no_match. A missing date fails the period, whose ends belong to it."""
    missing = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    outside = ~F.coalesce(F.col("published").between(start, end), F.lit(False))
    status = F.when(outside, "outside_period").when(missing("text") | missing("url") | missing("source"), "insufficient_evidence").when(F.coalesce(matches, F.lit(False)), "candidate").otherwise("no_match")
    return records.withColumn("status", status)


def duplicate_links(records: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """(basis, u, v): each record is linked to the one before it, by id, with the same key; blank keys never link.

    Records are put in ranges of (key, id), so a frequent key spreads over several of them. Within a range a record looks
    one row back; the first record of a range looks at the last one of the range before. Those ends, one for each shuffle
    partition, are all that meets in one task.
    """
    found = None
    for basis, key in keys.items():
        held = records.select(F.col(id_col).alias("v"), key.alias("k")).where("trim(k) <> ''").select("v", F.sha2("k", 256).alias("k"))
        placed = stash(held.repartitionByRange("k", "v").withColumn("range", F.spark_partition_id()), "links")
        inside = placed.withColumn("u", F.lag("v").over(W.partitionBy("range", "k").orderBy("v"))).where("u is not null").select("u", "v")
        ends = placed.groupBy("range").agg(F.min(F.struct("k", "v")).alias("first"), F.max(F.struct("k", "v")).alias("last"))
        across = ends.withColumn("before", F.lag("last").over(W.orderBy("range"))).where("before.k = first.k")
        linked = inside.unionByName(across.select(F.col("before.v").alias("u"), F.col("first.v").alias("v"))).select(F.lit(basis).alias("basis"), "u", "v")
        found = linked if found is None else found.unionByName(linked)
    return found


def duplicate_groups(records: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """(node, component): records that exact keys join, each with the smallest id of its group.

    Each record is linked to the smallest id with its key, by the hash of the key. The smallest ids come from an aggregate
    and are written before they are joined back, so Spark broadcasts them or cuts the part of a frequent key.
    """
    found = None
    for key in keys.values():
        held = records.select(F.col(id_col).alias("v"), key.alias("k")).where("trim(k) <> ''").select("v", F.sha2("k", 256).alias("k"))
        least = stash(held.groupBy("k").agg(F.min("v").alias("u"), F.count("*").alias("n")).where("n > 1"), "least-ids")
        linked = held.join(least, "k").select("u", "v")
        found = linked if found is None else found.unionByName(linked)
    return connected_components(found)


def completeness(expected: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """(key, problem): expected without a decision, decisions on the unexpected, and repeated decisions."""
    have = decided.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key).distinct().withColumn("due", F.lit(True)).join(have, key, "full_outer")
    problem = F.when(F.col("due").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def merge_identical(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node_id, type_id, name, value), conflicts): properties of equal entities united; of several values of a property the
    one from the batch with the smallest checksum stays, and the property is listed as a conflict."""
    keys = ["node_id", "type_id", "name"]
    united = entities.groupBy(*keys).agg(F.min_by("value", F.struct("batch_sha", "value")).alias("value"), F.count_distinct("value").alias("values"))
    return united.drop("values"), united.where("values > 1").select(*keys, "values")
