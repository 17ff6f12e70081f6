"""Checks of delimited activity tables, catalogue codes and the guard of written cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.storage import stash

NUMERIC = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check, in order, that holds; null if none does."""
    code = F.lit(None).cast("string")
    for name, failed in reversed(checks):
        code = F.when(failed, F.lit(name)).otherwise(code)
    return code


def mark_later(df: DataFrame, key: str, order: str, into: str) -> DataFrame:
    """df with a flag that is true for every row but the first, by order, of a trimmed key; nulls are one key.

    The first row of a key is found by an aggregate, written and joined back: Spark broadcasts the first rows where they are
    few and cuts the part of a frequent key where they are not, so its rows never meet in one task.
    """
    place = F.trim(F.col(key))
    first = stash(df.groupBy(place.alias("__key")).agg(F.min(order).alias("__first")), "first-rows")
    return df.join(first, place.eqNullSafe(F.col("__key")), "left").withColumn(into, F.col(order) > F.col("__first")).drop("__key", "__first")


def guard_cell(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe; numbers that fill their cell do not."""
    trigger = c.rlike(r"^[\s\x{FEFF}]*[=+\-@|%]") & ~F.trim(c).rlike(NUMERIC)
    return F.when(trigger, F.concat(F.lit("'"), c)).otherwise(c)


def levels_valid(levels: Column) -> Column:
    """Levels start at 1 and rise strictly; an empty list is valid."""
    rising = F.forall(F.zip_with(levels, F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a, b: F.coalesce(b > a, F.lit(True))), lambda x: x)
    return (F.size(levels) == 0) | ((F.get(levels, F.lit(0)) == 1) & rising)


def unknown_values(df: DataFrame, columns: list[str], known: DataFrame) -> DataFrame:
    """Distinct value combinations of df that the dictionary does not have."""
    return df.select(*columns).distinct().join(known.select(*columns).distinct(), columns, "left_anti")


def codes(df: DataFrame, name: str, into: str) -> DataFrame:
    """Distinct names numbered from 1 in sorted order; null gets none.

    The dictionary is sorted in ranges. A range's names are numbered on their own and moved by the sizes of the ranges
    before it; only these sizes, one for each shuffle partition, meet in one task.
    """
    names = df.select(name).where(F.col(name).isNotNull()).distinct().repartitionByRange(name)
    placed = stash(names.withColumn("__range", F.spark_partition_id()), "codes")
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = placed.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    return moved.select(name, (F.col("__before") + F.row_number().over(W.partitionBy("__range").orderBy(name))).alias(into))


def sheet_records(rows: DataFrame, header: list[str], keys: list[str], expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, row, one column for each name of header), (path, code)) of sheets given as (path, row, cells), row 1 the header.

    A sheet whose first row is not exactly the header is refused (header); rows whose key cells are all null are skipped, cells
    that are not there are null. expected (path, n) holds the number of rows that must be left: another number refuses the
    sheet (count), as does one that was not handed in (missing). Sheets that are refused give no rows.
    """
    right = rows.where((F.col("row") == 1) & (F.col("cells") == F.array(*(F.lit(h) for h in header)))).select("path").distinct()
    problems = rows.select("path").distinct().join(right, "path", "left_anti").select("path", F.lit("header").alias("code"))
    cells = [F.get("cells", F.lit(k)).alias(h) for k, h in enumerate(header)]
    kept = rows.where("row > 1").join(right, "path", "left_semi").select("path", "row", *cells)
    kept = kept.na.drop(how="all", subset=keys)
    if expected is not None:
        counted = kept.groupBy("path").agg(F.count("*").alias("found"))
        due = expected.select("path", "n").join(rows.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").join(counted, "path", "left")
        due = due.join(problems.select("path"), "path", "left_anti")
        off = due.where("there is null or n <> coalesce(found, 0)").select("path", F.when(F.col("there").isNull(), "missing").otherwise("count").alias("code"))
        problems = problems.unionByName(off)
    return kept.join(problems.select("path"), "path", "left_anti"), problems
