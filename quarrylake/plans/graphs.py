"""Queries over property graphs and production series, with the star schema in their roles: region is a field, nation a
well, supplier a wellbore, (supplier, part) of lineitem a log, and lineitem by ship day a production record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.operators import graph, production
from quarrylake.storage import table

S = SparkSession


def _logs(spark: S, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()


def _nodes(spark: S, d: str) -> DataFrame:
    log = F.concat_ws("-", "l_suppkey", "l_partkey")
    return (
        graph.nodes_from(table(spark, d, "region"), "Field", F.concat(F.lit("f"), F.col("r_regionkey")), {"name": F.col("r_name")})
        .unionByName(graph.nodes_from(table(spark, d, "nation"), "Well", F.concat(F.lit("w"), F.col("n_nationkey")), {"name": F.col("n_name")}))
        .unionByName(graph.nodes_from(table(spark, d, "supplier"), "Wellbore", F.concat(F.lit("b"), F.col("s_suppkey")), {"name": F.col("s_name"), "balance": F.col("s_acctbal").cast("decimal(12,2)")}))
        .unionByName(graph.nodes_from(_logs(spark, d), "WellLog", F.concat(F.lit("l"), log), {}))
    )


def _edges(spark: S, d: str) -> DataFrame:
    logs, log = _logs(spark, d), F.concat(F.lit("l"), F.concat_ws("-", "l_suppkey", "l_partkey"))
    return (
        graph.edges_from(table(spark, d, "nation"), "IN_FIELD", F.concat(F.lit("w"), F.col("n_nationkey")), F.concat(F.lit("f"), F.col("n_regionkey")))
        .unionByName(graph.edges_from(table(spark, d, "supplier"), "OF_WELL", F.concat(F.lit("b"), F.col("s_suppkey")), F.concat(F.lit("w"), F.col("s_nationkey"))))
        .unionByName(graph.edges_from(logs, "OF_WELLBORE", log, F.concat(F.lit("b"), F.col("l_suppkey"))))
    )


def graph_counts(spark: S, d: str) -> DataFrame:
    nodes = _nodes(spark, d).groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return nodes.unionByName(_edges(spark, d).groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n"))


def graph_endpoint_check(spark: S, d: str) -> DataFrame:
    nodes = _nodes(spark, d).where("not (label = 'Wellbore' and cast(substring(key, 2) as int) % 10 = 0)")
    good, issues = graph.resolve_edges(_edges(spark, d).where("type = 'OF_WELLBORE'"), nodes, "WellLog", "Wellbore")
    return issues.groupBy("reason").agg(F.count("*").alias("n")).unionByName(good.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("reason"), "n"))


def graph_first_wins_dedup(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit(0).alias("pos"))
    copies = s.where("s_suppkey % 3 = 0").withColumn("pos", F.lit(1)).unionByName(s.where("s_suppkey % 5 = 0").select("s_suppkey", F.lower("s_name").alias("s_name"), F.lit(2).alias("pos")))
    first, report = graph.first_wins(s.unionByName(copies), ["s_suppkey"], ["pos"], ["s_name"])
    return first.join(report, "s_suppkey").select("s_suppkey", "s_name", "seen", "duplicates", "conflicting")


def graph_one_hop(spark: S, d: str) -> DataFrame:
    wells = _nodes(spark, d).where("label = 'Well'").select(F.col("key").alias("well"), F.element_at("properties", "name").alias("well_name"))
    bores = _edges(spark, d).where("type = 'OF_WELL'").select(F.col("start_key").alias("wellbore"), F.col("end_key").alias("well"))
    return wells.join(bores, "well").select("well", "well_name", "wellbore")


def graph_two_hop(spark: S, d: str) -> DataFrame:
    """Which wellbore and well each log belongs to."""
    edges = _edges(spark, d)
    start = edges.where("type = 'OF_WELLBORE'").select(F.col("start_key").alias("log"), F.col("end_key").alias("wellbore"))
    return graph.hop(start, edges, "OF_WELL", "wellbore", "well").groupBy("well", "wellbore").agg(F.count("*").alias("logs"))


def required_labels(spark: S, d: str) -> DataFrame:
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, ("Field", "Well", "Wellbore", "WellLog", "Reservoir")))).alias("label"))
    return names.join(_nodes(spark, d).select("label").distinct(), "label", "left_anti")


def graph_upsert_report(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    key = F.concat(F.lit("b"), F.col("s_suppkey"))
    old = graph.nodes_from(s.where("s_suppkey % 3 <> 0"), "Wellbore", key, {"name": F.lower("s_name"), "old": F.lit("1")})
    new = graph.nodes_from(s.where("s_suppkey % 2 = 0"), "Wellbore", key, {"name": F.col("s_name")})
    merged = graph.upsert_nodes(old, new)
    return merged.select("key", "outcome", F.element_at("properties", "name").alias("name"), F.size("properties").alias("properties"))


def graph_load_idempotent(spark: S, d: str) -> DataFrame:
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    n = graph.upsert_nodes(nodes, nodes).groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "outcome", "n")
    return n.unionByName(graph.upsert_edges(edges, edges, nodes).groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "outcome", "n"))


def osdu_id_normalize(spark: S, d: str) -> DataFrame:
    raw = F.concat(F.lit(" part%3Amaster-data--Well:"), F.replace(F.col("c_name"), F.lit("#"), F.lit("%2F")), F.when(F.col("c_custkey") % 2 == 0, ":").otherwise(""))
    held = table(spark, d, "customer").select("c_custkey", graph.normalize_id(raw).alias("id"))
    parts = graph.parse_id(F.col("id"))
    return held.select("c_custkey", "id", *(c.alias(n) for n, c in parts.items()))


def surrogate_log_id(spark: S, d: str) -> DataFrame:
    return _logs(spark, d).select("l_suppkey", "l_partkey", graph.surrogate_key(F.col("l_suppkey"), F.col("l_partkey"), F.lit("log")).alias("id"))


def entity_in_field(spark: S, d: str) -> DataFrame:
    field = table(spark, d, "region").where("r_regionkey = 0").select(F.col("r_name").alias("field"))
    return table(spark, d, "nation").crossJoin(F.broadcast(field)).select("n_nationkey", "field")


def _records(spark: S, d: str) -> DataFrame:
    raw = F.when(F.col("l_returnflag") == "N", F.lit("NULL")).otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" ")))
    line = table(spark, d, "lineitem").withColumn("oil", production.number(raw)).withColumn("day", F.to_date("l_shipdate"))
    sums = line.groupBy("l_suppkey", "day").agg(F.sum("oil").alias("oil"), F.sum("l_quantity").alias("gas"))
    return production.daily(sums, F.col("l_suppkey"), F.col("day"), {"oil": F.col("oil"), "gas": F.col("gas")})


def production_daily(spark: S, d: str) -> DataFrame:
    return _records(spark, d)


def production_monthly(spark: S, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y"), (F.month("l_shipdate") + F.when(F.col("l_linenumber") == 7, 12).otherwise(0)).alias("m")).agg(F.sum("l_quantity").alias("oil"))
    return production.monthly(line, F.col("l_suppkey"), F.col("y"), F.col("m"), {"oil": F.col("oil")})


def production_field_scaled(spark: S, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return line.groupBy("r_name", F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg((F.sum("l_quantity") * 1e6).alias("oil_sm3"), (F.sum("l_quantity") * 1e9).alias("gas_sm3"))


def production_reconcile(spark: S, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_tax")
    b = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") + F.when(F.col("l_returnflag") == "A", 1e-3).otherwise(0.0)).alias("l_quantity"), "l_tax")
    return production.reconcile(a, b, "l_returnflag", ["l_quantity", "l_tax"])


def production_orphans(spark: S, d: str) -> DataFrame:
    known = table(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("entity"))
    return _records(spark, d).join(known, "entity", "left_anti").groupBy("entity").agg(F.count("*").alias("records"))


def production_series(spark: S, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), "s_name")
    point = F.format_string("POINT (%d %d)", F.col("entity") % 180, F.col("entity") % 90)
    return _records(spark, d).join(names, "entity").where("period_start >= '1995-01-01' and period_start < '1995-02-01'").select("s_name", "period_start", "oil", point.alias("wkt"))


def graph_edges_from_columns(spark: S, d: str) -> DataFrame:
    r = _records(spark, d)
    a = graph.edges_from(r, "FOR_ENTITY", F.col("uid"), F.col("entity"))
    b = graph.edges_from(r, "FROM_DATASET", F.col("uid"), F.concat(F.lit("dataset:"), F.year("period_start")))
    return a.unionByName(b).groupBy("type", "end_key").agg(F.count("*").alias("n"))


def package_duplicate_edges(spark: S, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return edges.groupBy("source", "target").agg(F.count("*").alias("n")).where("n > 1")


def bbox_and_ranges(spark: S, d: str) -> DataFrame:
    ring = F.array(*(F.struct((F.col("s_suppkey") % 200 - 10 + k).cast("double").alias("lon"), (F.col("s_suppkey") % 100 - 5 + k % 2).cast("double").alias("lat")) for k in range(4)))
    axis = lambda f: F.transform("ring", lambda p: p[f])
    boxes = table(spark, d, "supplier").withColumn("ring", ring).select("s_suppkey", F.array_min(axis("lon")).alias("west"), F.array_max(axis("lon")).alias("east"), F.array_min(axis("lat")).alias("south"), F.array_max(axis("lat")).alias("north"))
    return boxes.withColumn("in_range", F.col("west").between(-180, 180) & F.col("east").between(-180, 180) & F.col("south").between(-90, 90) & F.col("north").between(-90, 90))


def geojson_features(spark: S, d: str) -> DataFrame:
    text = F.concat(F.lit('{"features":[{"properties":{"id":'), F.col("s_suppkey"), F.lit('},"geometry":{"type":"Point","coordinates":['), F.col("s_suppkey") % 180, F.lit(","), F.col("s_suppkey") % 90, F.lit("]}}]}"))
    shape = "struct<features:array<struct<properties:struct<id:bigint>,geometry:struct<type:string,coordinates:array<double>>>>>"
    held = table(spark, d, "supplier").select(F.explode(F.from_json(text, shape)["features"]).alias("f"))
    return held.select("f.properties.id", F.col("f.geometry.type").alias("type"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


QUERIES = {f.__name__: f for f in (graph_counts, graph_endpoint_check, graph_first_wins_dedup, graph_one_hop, graph_two_hop, required_labels, graph_upsert_report, graph_load_idempotent, osdu_id_normalize, surrogate_log_id, entity_in_field, production_daily, production_monthly, production_field_scaled, production_reconcile, production_orphans, production_series, graph_edges_from_columns, package_duplicate_edges, bbox_and_ranges, geojson_features)}

_REC = """rec AS (
  SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS period_start, sum(CASE WHEN l_returnflag <> 'N' THEN floor(l_quantity) END)::DOUBLE AS oil,
         sum(l_quantity) AS gas, 'urn:production:daily:' || l_suppkey || ':' || strftime(l_shipdate, '%Y-%m-%d') AS uid
  FROM lineitem GROUP BY ALL)"""

SQL = {
    "graph_counts": """
WITH logs AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT 'node' AS kind, 'Field' AS name, count(*) AS n FROM region UNION ALL SELECT 'node', 'Well', count(*) FROM nation
UNION ALL SELECT 'node', 'Wellbore', count(*) FROM supplier UNION ALL SELECT 'node', 'WellLog', count(*) FROM logs
UNION ALL SELECT 'edge', 'IN_FIELD', count(*) FROM nation UNION ALL SELECT 'edge', 'OF_WELL', count(*) FROM supplier
UNION ALL SELECT 'edge', 'OF_WELLBORE', count(*) FROM logs""",
    "graph_endpoint_check": """
WITH logs AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
j AS (SELECT CASE WHEN s_suppkey IS NULL THEN 'dangling_end' ELSE 'accepted' END AS reason FROM logs LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 10 <> 0)
SELECT reason, count(*) AS n FROM j GROUP BY reason""",
    "graph_first_wins_dedup": """
SELECT s_suppkey, s_name, 1 + (s_suppkey % 3 = 0)::BIGINT + (s_suppkey % 5 = 0)::BIGINT AS seen,
       (s_suppkey % 3 = 0)::BIGINT + (s_suppkey % 5 = 0)::BIGINT AS duplicates, s_suppkey % 5 = 0 AND s_name <> lower(s_name) AS conflicting FROM supplier""",
    "graph_one_hop": "SELECT 'w' || n_nationkey AS well, n_name AS well_name, 'b' || s_suppkey AS wellbore FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    "graph_two_hop": """
SELECT 'w' || s_nationkey AS well, 'b' || s_suppkey AS wellbore, count(DISTINCT l_partkey) AS logs
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, s_suppkey""",
    "required_labels": "SELECT 'Reservoir' AS label",
    "graph_upsert_report": """
SELECT 'b' || s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'created' WHEN s_suppkey % 2 = 0 THEN 'matched' ELSE 'kept' END AS outcome,
       CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE lower(s_name) END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS properties
FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0""",
    "graph_load_idempotent": """
WITH logs AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT 'node' AS kind, 'matched' AS outcome, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM logs) AS n
UNION ALL SELECT 'edge', 'matched', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM logs)""",
    "osdu_id_normalize": """
SELECT c_custkey, 'part:master-data--Well:' || replace(c_name, '#', '/') AS id, 'part' AS partition, 'master-data' AS "group", 'Well' AS type, replace(c_name, '#', '/') AS record FROM customer""",
    "surrogate_log_id": """
SELECT DISTINCT l_suppkey, l_partkey, sha256('["' || l_suppkey || '","' || l_partkey || '","log"]') AS id FROM lineitem""",
    "entity_in_field": "SELECT n_nationkey, r_name AS field FROM nation, region WHERE r_regionkey = 0",
    "production_daily": f"WITH {_REC} SELECT uid, entity, period_start, period_start + 1 AS period_end, oil, gas FROM rec",
    "production_monthly": """
WITH m AS (SELECT l_suppkey AS entity, year(l_shipdate) AS y, month(l_shipdate) + CASE WHEN l_linenumber = 7 THEN 12 ELSE 0 END AS m, sum(l_quantity) AS oil FROM lineitem GROUP BY ALL)
SELECT 'urn:production:monthly:' || entity || ':' || y || '-' || lpad(m::VARCHAR, 2, '0') AS uid, entity, make_date(y, m, 1) AS period_start,
       CAST(make_date(y, m, 1) + INTERVAL 1 MONTH AS DATE) AS period_end, oil FROM m WHERE m BETWEEN 1 AND 12""",
    "production_field_scaled": """
SELECT r_name, year(l_shipdate) AS y, month(l_shipdate) AS m, sum(l_quantity) * 1e6 AS oil_sm3, sum(l_quantity) * 1e9 AS gas_sm3
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "production_reconcile": """
WITH a AS (SELECT l_returnflag, sum(l_quantity::DECIMAL(38,6))::DOUBLE AS q, sum(l_tax::DECIMAL(38,6))::DOUBLE AS t,
                  sum((l_quantity + CASE WHEN l_returnflag = 'A' THEN 1e-3 ELSE 0 END)::DECIMAL(38,6))::DOUBLE AS q2 FROM lineitem GROUP BY 1),
u AS (SELECT l_returnflag, 'l_quantity' AS measure, q AS left_sum, q2 AS right_sum FROM a UNION ALL SELECT l_returnflag, 'l_tax', t, t FROM a)
SELECT *, abs(left_sum - right_sum) <= greatest(1e-6, abs(left_sum) * 1e-12) AS agrees FROM u""",
    "production_orphans": f"WITH {_REC} SELECT entity, count(*) AS records FROM rec WHERE entity NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0) GROUP BY entity",
    "production_series": f"""
WITH {_REC} SELECT s_name, period_start, oil, 'POINT (' || entity % 180 || ' ' || entity % 90 || ')' AS wkt FROM rec JOIN supplier ON entity = s_suppkey
WHERE period_start >= DATE '1995-01-01' AND period_start < DATE '1995-02-01'""",
    "graph_edges_from_columns": f"""
WITH {_REC} SELECT 'FOR_ENTITY' AS type, entity::VARCHAR AS end_key, count(*) AS n FROM rec GROUP BY 2
UNION ALL SELECT 'FROM_DATASET', 'dataset:' || year(period_start), count(*) FROM rec GROUP BY 2""",
    "package_duplicate_edges": "SELECT l_suppkey AS source, l_partkey AS target, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "bbox_and_ranges": """
WITH b AS (SELECT s_suppkey, (s_suppkey % 200 - 10)::DOUBLE AS west, (s_suppkey % 200 - 7)::DOUBLE AS east, (s_suppkey % 100 - 5)::DOUBLE AS south, (s_suppkey % 100 - 4)::DOUBLE AS north FROM supplier)
SELECT *, west BETWEEN -180 AND 180 AND east BETWEEN -180 AND 180 AND south BETWEEN -90 AND 90 AND north BETWEEN -90 AND 90 AS in_range FROM b""",
    "geojson_features": "SELECT s_suppkey AS id, 'Point' AS type, (s_suppkey % 180)::DOUBLE AS lon, (s_suppkey % 90)::DOUBLE AS lat FROM supplier",
}
