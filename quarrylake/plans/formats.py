"""Queries over seismic headers and well documents, built from parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.operators import production
from quarrylake.sources import formats
from quarrylake.storage import stash, table

S = SparkSession
MARKER = "C 1 CLIENT"


def _text(c: str):
    return F.col(c).cast("string")


def segy_catalogue(spark: S, d: str) -> DataFrame:
    """One SEG-Y file for each part: some are empty, truncated or of a later revision, some have another text."""
    code = lambda v, width: F.unhex(F.lpad(F.hex(v.cast("long")), 2 * width, "0"))
    zeros = lambda n: F.unhex(F.repeat(F.lit("00"), n))
    size = F.col("p_size")
    text = F.encode(F.rpad(F.concat(F.when(size % 2 == 0, MARKER).otherwise("X"), F.col("p_name")), 3200, " "), "US-ASCII")
    revision = F.when(size % 5 == 0, F.unhex(F.lit("0200"))).otherwise(F.unhex(F.lit("0101")))
    head = F.concat(text, code(F.col("p_partkey"), 4), F.unhex(F.lit("FFFFFFFE")), zeros(12), code(size * 10, 2), zeros(2), code(F.lit(5), 2), zeros(274), revision, zeros(98))
    content = F.when(size % 11 == 0, F.substring(head, 1, 0)).when(size % 7 == 0, F.substring(head, 1, 3599)).otherwise(head)
    found = formats.segy(table(spark, d, "part").select(_text("p_partkey").alias("path"), content.alias("content")), MARKER)
    of = lambda n: F.col("header")[n]
    return found.select(F.col("path").cast("long").alias("p_partkey"), "status", "reason", "version", "marked", of("JobID").alias("job"), of("LineNumber").alias("line"), of("Samples").alias("samples"), of("Format").alias("format"))


def witsml_documents(spark: S, d: str) -> DataFrame:
    """Documents of ten customers each as wells: status, texts, measures, and what each well lacks."""
    key, tag = F.col("c_custkey"), lambda n, v, a="": F.concat(F.lit(f"<{n}{a}>"), v, F.lit(f"</{n}>"))
    well = F.concat(
        F.lit('<well uid="'), _text("c_custkey"), F.lit('">'), tag("name", F.col("c_name")), F.when(key % 5 != 0, tag("field", F.col("c_mktsegment"))).otherwise("<field> </field>"), tag("timeZone", F.lit("Z")),
        F.when(key % 3 == 0, tag("wellheadElevation", _text("c_nationkey"))).otherwise(tag("wellheadElevation", _text("c_nationkey"), ' uom="m"')),
        F.when(F.col("c_nationkey") % 2 == 0, tag("country", _text("c_nationkey"))).otherwise(""), tag("waterDepth", _text("c_custkey"), ' uom="ft"'), F.lit("</well>"),
    )
    docs = table(spark, d, "customer").groupBy(F.floor(key / 10).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", well.alias("xml")))).alias("w"))
    version = F.when(F.col("doc") % 4 == 3, "2.0").otherwise("1.4.1.1")
    end = F.when(F.col("doc") % 6 == 5, "").otherwise("</wells>")
    xml = F.concat(F.lit(f'<wells xmlns="{formats.WITSML_NAMESPACE}" version="'), version, F.lit('">'), F.array_join("w.xml", ""), end)
    held = stash(docs.select(_text("doc").alias("path"), xml.cast("binary").alias("content")), "witsml")
    found = formats.witsml(held)
    return found.select(
        F.col("path").cast("long").alias("doc"), "status", "reason", F.col("uid").cast("long").alias("c_custkey"), "name", "field", F.col("elevation.value").cast("long").alias("elevation"),
        F.col("texts")["country"].alias("country"), F.col("measures")["waterDepth"]["value"].cast("long").alias("depth"), F.array_join("missing", ",").alias("missing"),
    )


def geojson_files(spark: S, d: str) -> DataFrame:
    """Files of fifty customers each as points and polygons: place and box of each feature, or why the file is refused."""
    key, g = F.col("c_custkey"), F.floor(F.col("c_custkey") / 50)
    lon, lat = key % 170, key % 80 + F.when((g % 4 == 1) & (key % 50 == 9), 90).otherwise(0)
    point = F.format_string('{"properties":{"name":"%s"},"geometry":{"type":"Point","coordinates":[%d,%d]}}', "c_name", lon, lat)
    polygon = F.format_string('{"properties":{"name":"%s"},"geometry":{"type":"Polygon","coordinates":[[[%d,%d],[%d,%d],[%d,%d]]]}}', "c_name", lon, lat, lon + 5, lat, lon, lat + 3)
    feature = F.when((key % 3 == 0) & (lat < 80), polygon).otherwise(point)
    held = table(spark, d, "customer").select(g.alias("g"), feature.alias("f")).groupBy("g").agg(F.collect_list("f").alias("l"))
    end = F.when(F.col("g") % 5 == 4, "").otherwise("]}")
    files = held.select(_text("g").alias("path"), F.concat(F.lit('{"features":['), F.array_join("l", ","), end).alias("content"))
    due = held.select(_text("g").alias("path"), (F.size("l") + F.when(F.col("g") % 7 == 2, 1).otherwise(0)).cast("long").alias("n"))
    features, problems = formats.geojson(files, due)
    told = features.select(F.col("path").cast("long").alias("g"), F.col("properties")["name"].alias("name"), "type", "lon", "lat", "west", "east", "south", "north", F.lit(None).cast("string").alias("code"))
    return told.unionByName(problems.select(F.col("path").cast("long").alias("g"), "code"), allowMissingColumns=True)


def field_months(spark: S, d: str) -> DataFrame:
    """Suppliers as fields: quantities and prices of each month as field production, blank where nothing was returned."""
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"))
    total = lambda c, where: F.sum(F.when(where, F.col(c).cast("decimal(18,2)")))
    source = lines.agg(
        total("l_quantity", F.col("l_returnflag") == "A").cast("string").alias("prfPrdOilNetMillSm3"), F.coalesce(total("l_quantity", F.col("l_returnflag") == "R").cast("string"), F.lit("NULL")).alias("prfPrdGasGrossBillSm3"),
        total("l_extendedprice", F.lit(True)).cast("string").alias("prfInvestmentsMillNOK"),
    )
    found = production.field_months(source, F.col("l_suppkey"), F.col("y"), F.col("m"))
    return found.select(F.col("entity").alias("l_suppkey"), "period_start", "period_end", F.round("oilNetVolumeSm3").alias("oil"), F.round("gasGrossVolumeSm3").alias("gas"), F.col("nglNetVolumeSm3").alias("ngl"), F.col("investmentMillionNok").alias("invested"))


QUERIES = {f.__name__: f for f in (segy_catalogue, witsml_documents, geojson_files, field_months)}

SQL = {
    "geojson_files": """
WITH c AS (SELECT c_name, c_custkey // 50 AS g, c_custkey % 170 AS lon, c_custkey % 80 + CASE WHEN c_custkey // 50 % 4 = 1 AND c_custkey % 50 = 9 THEN 90 ELSE 0 END AS lat, c_custkey % 3 = 0 AS third FROM customer),
f AS (SELECT *, third AND lat < 80 AS ring, max(lat) OVER (PARTITION BY g) > 90 AS far FROM c),
s AS (SELECT *, CASE WHEN g % 5 = 4 THEN 'invalid' WHEN far THEN 'geometry' WHEN g % 7 = 2 THEN 'count' END AS code FROM f)
SELECT g, c_name AS name, CASE WHEN ring THEN 'Polygon' ELSE 'Point' END AS type, CASE WHEN NOT ring THEN lon::DOUBLE END AS lon, CASE WHEN NOT ring THEN lat::DOUBLE END AS lat,
  CASE WHEN ring THEN lon::DOUBLE END AS west, CASE WHEN ring THEN lon + 5.0::DOUBLE END AS east, CASE WHEN ring THEN lat::DOUBLE END AS south, CASE WHEN ring THEN lat + 3.0::DOUBLE END AS north, code FROM s WHERE code IS NULL
UNION ALL SELECT DISTINCT g, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, code FROM s WHERE code IS NOT NULL""",
    "field_months": """
WITH m AS (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS start, sum(l_quantity::DECIMAL(18,2)) FILTER (l_returnflag = 'A') AS a, sum(l_quantity::DECIMAL(18,2)) FILTER (l_returnflag = 'R') AS r,
  sum(l_extendedprice::DECIMAL(18,2)) AS p FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, start AS period_start, (start + INTERVAL 1 MONTH)::DATE AS period_end, round(a::DOUBLE * 1e6) AS oil, round(r::DOUBLE * 1e9) AS gas, NULL::DOUBLE AS ngl, p::DOUBLE AS invested FROM m""",
    "segy_catalogue": """
WITH p AS (SELECT *, CASE WHEN p_size % 11 = 0 THEN 'empty' WHEN p_size % 7 = 0 THEN 'corrupt_input' WHEN p_size % 5 = 0 THEN 'unsupported_version' ELSE 'ok' END AS status FROM part)
SELECT p_partkey, status, CASE status WHEN 'empty' THEN 'empty_file' WHEN 'corrupt_input' THEN 'truncated_header' WHEN 'unsupported_version' THEN 'segy_revision_ge_2' END AS reason,
  CASE status WHEN 'unsupported_version' THEN '2.0' WHEN 'ok' THEN '1.1' END AS version, CASE WHEN status NOT IN ('empty', 'corrupt_input') THEN p_size % 2 = 0 END AS marked,
  CASE WHEN status NOT IN ('empty', 'corrupt_input') THEN p_partkey END AS job, CASE WHEN status NOT IN ('empty', 'corrupt_input') THEN -2 END AS line,
  CASE WHEN status NOT IN ('empty', 'corrupt_input') THEN p_size * 10 END AS samples, CASE WHEN status NOT IN ('empty', 'corrupt_input') THEN 5 END AS format FROM p""",
    "witsml_documents": """
WITH c AS (SELECT *, c_custkey // 10 AS doc, c_custkey - min(c_custkey) OVER (PARTITION BY c_custkey // 10) AS place, min(c_custkey) OVER (PARTITION BY c_custkey // 10) AS first FROM customer),
s AS (SELECT *, CASE WHEN doc % 6 = 5 THEN 'corrupt_input' WHEN doc % 4 = 3 THEN 'unsupported_version' WHEN first % 3 = 0 OR first % 5 = 0 THEN 'incomplete' ELSE 'ok' END AS status FROM c)
SELECT doc, status, CASE WHEN status = 'incomplete' THEN 'missing_fields' END AS reason, c_custkey, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS field, c_nationkey AS elevation,
  CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey::VARCHAR END AS country, c_custkey AS depth,
  concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN place > 0 THEN 'wells[' || place || '].' ELSE '' END || 'wellheadElevation.uom' END,
    CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN place > 0 THEN 'wells[' || place || '].' ELSE '' END || 'field' END) AS missing FROM s WHERE status IN ('ok', 'incomplete')
UNION ALL SELECT DISTINCT doc, status, CASE status WHEN 'corrupt_input' THEN 'not_well_formed' ELSE 'witsml_2x' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM s WHERE status NOT IN ('ok', 'incomplete')""",
}
