"""Queries over written forms, hierarchies and refused rows: what is written is read back by the library's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.operators import graph, text
from quarrylake.sources import files, sinks
from quarrylake.storage import scratch_path, stash, table
from quarrylake.streaming import telemetry

S = SparkSession


def xlsx_rows(spark: S, d: str) -> DataFrame:
    """Parts written as spreadsheets and read back without their header rows; some cells are left out."""
    size = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size"))
    books = stash(sinks.workbooks(table(spark, d, "part").select("p_partkey", size.alias("p_size"), "p_name")), "workbooks")
    cell = lambda k: F.get("cells", F.lit(k))
    return files.worksheet(books).where("row > 1").select(cell(0).cast("long").alias("p_partkey"), cell(1).cast("int").alias("p_size"), cell(2).alias("p_name"))


def activity_file_round_trip(spark: S, d: str) -> DataFrame:
    """Activities written canonically and read back, their nested cells as JSON again."""
    p = F.col("p_partkey")
    level = F.struct(F.col("p_brand").alias("code"), (F.col("p_size") % 3 + 1).alias("level"))
    rows = table(spark, d, "part").select(
        F.concat(F.lit("A"), p).alias("activity_id"), F.concat(F.when(p % 5 == 0, "=").otherwise(""), F.col("p_name"), F.when(p % 3 == 0, ', "x"').otherwise("")).alias("activity_name"),
        F.col("p_size").alias("volume"), F.when(p % 7 != 0, "m").alias("measurement"), F.array(level).alias("structure"), F.array().cast("array<int>").alias("edges"), F.lit(None).cast("string").alias("granular_unit"),
    )
    path = scratch_path(spark, "activities")
    sinks.write_activities(rows, path)
    back = files.delimited(files.scan(spark, path, "part-*"))
    cell = lambda k: F.get("cells", F.lit(k))
    return back.select(cell(0).alias("activity_id"), cell(1).alias("activity_name"), cell(2).cast("int").alias("volume"), cell(3).alias("measurement"), sinks.parse_nested(cell(4)).alias("structure"), sinks.parse_nested(cell(5)).alias("edges"), (cell(6) == "").alias("no_unit"))


def nested_cell_literals(spark: S, d: str) -> DataFrame:
    """Nested cells as JSON, as Python literals, too deep, and as what is neither."""
    forms = ('[{"b":1,"a":"x"}]', "[{'b': 1, 'a': 'x'}]", "[[[[1]]]]", "open('x')", "", "[NaN]")
    cell = F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", sinks.parse_nested(cell).alias("parsed"))


def canonical_records(spark: S, d: str) -> DataFrame:
    """Checksums of suppliers' canonical JSON texts."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("s_nationkey"))
    return rows.select("s_suppkey", F.sha2(sinks.canonical_json(rows, rows.columns), 256).alias("sha"))


def field_features(spark: S, d: str) -> DataFrame:
    """Attributes of the features of JSON documents, one document for each supplier; missing measures stay null."""
    one = lambda month, oil: F.concat(F.lit('{"attributes":{"prfYear":2016,"prfMonth":'), F.lit(month), F.lit(',"oil":'), oil, F.lit("}}"))
    oil = F.when(F.col("s_suppkey") % 3 == 0, "null").otherwise((F.col("s_suppkey") % 10).cast("string"))
    doc = F.concat(F.lit('{"features":['), one("1", oil), F.lit(","), one("2", F.lit("0")), F.lit("]}"))
    kept = F.from_json("doc", "features array<struct<attributes:struct<prfYear:int,prfMonth:int,oil:double>>>")
    rows = table(spark, d, "supplier").select("s_suppkey", doc.alias("doc")).select("s_suppkey", F.explode(kept["features"]["attributes"]).alias("a"))
    start = F.make_date("a.prfYear", "a.prfMonth", F.lit(1))
    return rows.select("s_suppkey", start.alias("period_start"), F.add_months(start, 1).alias("period_end"), (F.col("a.oil") * 1_000_000).alias("oil"))


def taxonomy_cycles(spark: S, d: str) -> DataFrame:
    """Terms that never reach a root: chains of ten below each root, every seventh chain closed to a cycle."""
    p = F.col("p_partkey")
    chain, at = F.floor(p / 10), p % 10
    parent = F.when(at > 0, p - 1).when(chain % 7 == 3, p + 6)
    return graph.parent_cycles(table(spark, d, "part").select(p.alias("key"), parent.alias("parent")))


def identical_events(spark: S, d: str) -> DataFrame:
    """Event contents under several ids, with the first id."""
    content = F.sha2(F.concat_ws("|", "event_type", "user_id", "props"), 256)
    return table(spark, d, "events").groupBy(content.alias("content")).agg(F.count("*").alias("n"), F.min("event_id").alias("first")).where("n > 1")


def telemetry_quarantine(spark: S, d: str) -> DataFrame:
    """A stream split into sound and refused envelopes, counted by what is missing."""
    raw = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    e = F.col("event_id")
    points = raw.select(e.alias("point_id"), F.col("event_type").alias("tag"), F.when(e % 7 != 0, F.col("ts").cast("timestamp")).alias("measured_at"), "value", F.when(e % 4 != 0, "bar").alias("unit"))
    good, bad = scratch_path(spark, "sound"), scratch_path(spark, "refused")
    telemetry.split_by_status(points, good, bad, scratch_path(spark, "split-marks")).awaitTermination()
    found = spark.read.parquet(good).unionByName(spark.read.parquet(bad))
    return found.groupBy("status", F.array_join("missing_fields", ",").alias("missing")).agg(F.count("*").alias("n"))


def search_forms(spark: S, d: str) -> DataFrame:
    """Texts of transcripts as they are searched for, as checksums."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.search_form(F.col("text")), 256).alias("sha"))


QUERIES = {f.__name__: f for f in (xlsx_rows, activity_file_round_trip, nested_cell_literals, canonical_records, field_features, taxonomy_cycles, identical_events, telemetry_quarantine, search_forms)}

SQL = {
    "xlsx_rows": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS p_size, p_name FROM part",
    "activity_file_round_trip": """
SELECT 'A' || p_partkey AS activity_id, CASE WHEN p_partkey % 5 = 0 THEN '''=' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN ', "x"' ELSE '' END AS activity_name,
       p_size AS volume, CASE WHEN p_partkey % 7 <> 0 THEN 'm' ELSE '' END AS measurement,
       '[{"code":"' || p_brand || '","level":' || (p_size % 3 + 1) || '}]' AS structure, '[]' AS edges, true AS no_unit FROM part""",
    "nested_cell_literals": """SELECT p_partkey, CASE WHEN p_partkey % 6 < 2 THEN '[{"a":"x","b":1}]' END AS parsed FROM part""",
    "canonical_records": """
SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":' || CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey::VARCHAR ELSE 'null' END || ',"s_suppkey":' || s_suppkey || '}') AS sha FROM supplier""",
    "field_features": """
SELECT s_suppkey, DATE '2016-01-01' AS period_start, DATE '2016-02-01' AS period_end, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 10) * 1e6 END::DOUBLE AS oil FROM supplier
UNION ALL SELECT s_suppkey, DATE '2016-02-01', DATE '2016-03-01', 0::DOUBLE FROM supplier""",
    "taxonomy_cycles": """
WITH RECURSIVE t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 > 0 THEN p_partkey - 1 WHEN p_partkey // 10 % 7 = 3 THEN p_partkey + 6 END AS parent FROM part),
up AS (SELECT k AS key, k AS place FROM t UNION SELECT key, parent FROM up JOIN t ON k = place WHERE parent IN (SELECT k FROM t)),
rooted AS (SELECT key FROM up JOIN t ON k = place WHERE parent IS NULL OR parent NOT IN (SELECT k FROM t))
SELECT k AS key FROM t WHERE k NOT IN (SELECT key FROM rooted)""",
    "identical_events": "SELECT sha256(event_type || '|' || user_id || '|' || props) AS content, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1 HAVING count(*) > 1",
    "telemetry_quarantine": """
SELECT CASE WHEN event_id % 4 = 0 OR event_id % 7 = 0 THEN 'incomplete' ELSE 'ok' END AS status,
       concat_ws(',', CASE WHEN event_id % 4 = 0 THEN 'unit' END, CASE WHEN event_id % 7 = 0 THEN 'measured_at' END) AS missing, count(*) AS n FROM events GROUP BY 1, 2""",
    "search_forms": "SELECT conv_id, turn, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS sha FROM conversations",
}
