"""Queries over control questions, snapshots, sheets, dictionaries and news briefs. Customers are wells, orders wellbores or
notes, line items logs or what notes point at, parts terms; what is wrong is made so by rules over other columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators import briefs, controls, graph, tabular, vectors
from quarrylake.storage import scratch_path, table

S = SparkSession
TO_WELL, TO_BORE = "BELONGS_TO_WELL", "BELONGS_TO_WELLBORE"
SHEET = ["Wellbore", "Year", "Status", "Oil"]


def _text(c: str):
    return F.col(c).cast("string")


def _graph(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    """Wells, wellbores and logs; urgent wellbores have a name of their own, pending ones have lost their well."""
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    logs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    bore = F.concat(F.lit("bore "), _text("o_orderkey"), F.when(F.col("o_orderpriority") == "1-URGENT", " new").otherwise(""))
    log_key = F.concat(F.lit("l"), _text("l_orderkey"), F.lit("/"), _text("l_linenumber"))
    nodes = graph.nodes_from(customers, "Well", F.concat(F.lit("c"), _text("c_custkey")), {"name": F.col("c_name")})
    nodes = nodes.unionByName(graph.nodes_from(orders, "Wellbore", F.concat(F.lit("o"), _text("o_orderkey")), {"name": bore, "status": F.col("o_orderstatus")}))
    nodes = nodes.unionByName(graph.nodes_from(logs, "WellLog", log_key, {"name": F.concat(F.lit("log "), log_key)}))
    of_bore = graph.edges_from(logs, TO_BORE, log_key, F.concat(F.lit("o"), _text("l_orderkey")))
    of_well = graph.edges_from(orders.where("o_orderstatus <> 'P'"), TO_WELL, F.concat(F.lit("o"), _text("o_orderkey")), F.concat(F.lit("c"), _text("o_custkey")))
    return nodes, of_bore.unionByName(of_well)


def graph_controls(spark: S, d: str) -> DataFrame:
    """The wellbores of each well, the way up from each log, the key of each wellbore and the number of nodes, against the tables."""
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    logs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    log = F.concat(F.lit("log l"), _text("l_orderkey"), F.lit("/"), _text("l_linenumber"))
    bore = F.concat(F.lit("bore "), _text("o_orderkey"))
    question = lambda rows, form, label, subject, *path: rows.select(F.concat(F.lit(f"{form} "), subject).alias("id"), F.lit(form).alias("form"), F.lit(label).alias("label"), subject.alias("subject"), F.array(*(F.lit(p) for p in path)).cast("array<string>").alias("path"))
    labels = spark.createDataFrame([("Well",), ("Wellbore",), ("WellLog",), ("Rig",)], "label string")
    counted = labels.select(F.concat(F.lit("count "), "label").alias("id"), F.lit("count").alias("form"), "label", F.lit(None).cast("string").alias("subject"), F.array().cast("array<string>").alias("path"))
    asked = question(customers, "linked", "Wellbore", F.concat(F.lit("c"), _text("c_custkey")), TO_WELL)
    asked = asked.unionByName(question(logs, "path", "WellLog", log, TO_BORE, TO_WELL)).unionByName(question(orders, "key", "Wellbore", bore)).unionByName(counted)

    of_well = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    answer = lambda rows, i, v: rows.select(i.alias("id"), v.alias("value"))
    expected = answer(of_well, F.concat(F.lit("linked c"), _text("c_custkey")), bore)
    expected = expected.unionByName(answer(logs.join(of_well, F.col("l_orderkey") == F.col("o_orderkey")), F.concat(F.lit("path "), log), F.concat(bore, F.lit(" > "), "c_name")))
    expected = expected.unionByName(answer(orders, F.concat(F.lit("key "), bore), F.concat(F.lit("o"), _text("o_orderkey"))))
    for label, rows in (("Well", customers), ("Wellbore", orders), ("WellLog", logs), ("Rig", customers.where("c_custkey is null"))):
        expected = expected.unionByName(rows.agg(F.count("*").cast("string").alias("value")).select(F.lit(f"count {label}").alias("id"), "value"))
    nodes, edges = _graph(spark, d)
    return controls.results(asked, expected, controls.answers(asked, nodes, edges))


def graph_snapshot(spark: S, d: str) -> DataFrame:
    """The lines of a snapshot as written, nodes and edges."""
    path = scratch_path(spark, "snapshot")
    controls.snapshot(*_graph(spark, d), path)
    read = lambda kind: spark.read.text(f"{path}/{kind}").select(F.lit(kind).alias("kind"), F.col("value").alias("line"))
    return read("nodes").unionByName(read("edges"))


def sheet_checks(spark: S, d: str) -> DataFrame:
    """Sheets of fifty customers' orders: rows kept, or why the sheet is refused; of pending orders all key cells are null."""
    orders = table(spark, d, "orders").withColumn("g", F.floor(F.col("o_custkey") / 50))
    path, pending = F.concat(F.lit("sheet "), _text("g")), F.col("o_orderstatus") == "P"
    row = (F.row_number().over(W.partitionBy("g").orderBy("o_orderkey")) + 1).alias("row")
    cell = lambda c: F.when(~pending, c.cast("string"))
    body = orders.select(path.alias("path"), row, F.array(cell(F.col("o_orderkey")), cell(F.year("o_orderdate")), F.col("o_orderstatus"), _text("o_totalprice")).alias("cells"))
    names = F.array(*(F.lit(h) for h in SHEET[:3]), F.when(F.col("g") % 3 == 1, "Gas").otherwise("Oil"))
    heads = orders.select("g").distinct().select(path.alias("path"), F.lit(1).alias("row"), names.alias("cells"))
    due = orders.groupBy("g").agg(F.count_if(~pending).alias("n")).select(path.alias("path"), (F.col("n") + F.when(F.col("g") % 5 == 2, 1).otherwise(0)).alias("n"))
    absent = orders.select((F.max("g") + 1).alias("g")).select(path.alias("path"), F.lit(0).cast("long").alias("n"))
    records, problems = tabular.sheet_records(body.unionByName(heads), SHEET, SHEET[:2], due.unionByName(absent))
    kept = records.groupBy("path").agg(F.count("*").alias("rows"), F.sum(F.col("Oil").cast("decimal(18,2)")).cast("double").alias("oil"))
    return kept.join(problems, "path", "full_outer").select("path", "rows", "oil", "code")


def dictionary_scan(spark: S, d: str) -> DataFrame:
    """Dictionaries of fifty parts each: the number of entries of the sound ones, what is wrong with the others."""
    parts = table(spark, d, "part").withColumn("g", F.floor(F.col("p_partkey") / 50))
    kind, path = F.col("g") % 6, F.concat(F.lit("terms "), _text("g"))
    key = F.when(kind == 2, F.concat(F.lit("p"), (F.col("p_partkey") % 40).cast("string"))).when((kind == 3) & (F.col("p_partkey") % 50 == 7), " ").otherwise(F.concat(F.lit("p"), _text("p_partkey")))
    lists = parts.groupBy("g").agg(F.collect_list(F.to_json(F.struct(key.alias("id"), F.col("p_name").alias("name")))).alias("l"))
    field = F.when(kind == 5, "words").otherwise("terms")
    json = F.concat(F.lit('{"version":"'), F.when(kind == 1, " ").otherwise("1"), F.lit('","'), field, F.lit('":['), F.array_join("l", ","), F.when(kind == 4, "").otherwise("]}"))
    held = lists.select(path.alias("path"), json.alias("content"))
    wanted = lists.select("g").unionByName(lists.select((F.max("g") + 1).alias("g"))).select(path.alias("path"), F.lit("terms").alias("field"))
    entries, problems = briefs.dictionaries(held, wanted)
    found = entries.groupBy("path").agg(F.count("*").alias("entries"))
    return found.join(problems, "path", "full_outer").select("path", "entries", "code")


def brief_terminology(spark: S, d: str) -> DataFrame:
    """Part names as briefs' queries, their words as mentions: the first rule that each brief or mention breaks."""
    parts = table(spark, d, "part")
    asked = F.when(F.col("p_size") == 7, F.upper("p_name")).otherwise(F.col("p_name"))
    held = parts.select(F.col("p_partkey").alias("brief_id"), F.col("p_name").alias("query"), asked.alias("asked"), F.when(F.col("p_size") == 8, "0").otherwise("1").alias("terms_version"), F.lit("2").alias("taxonomy_version"))
    words = parts.select("p_partkey", "p_size", "p_brand", F.posexplode(F.split("p_name", " ")).alias("at", "word"))
    turn = (F.col("p_partkey") + F.col("at")) % 4
    kind = F.when(turn == 0, "expansion").when(turn == 1, "exclusion").otherwise("detected")
    fragment = F.when(F.col("p_size") == 4, F.upper("word")).otherwise(F.col("word"))
    mentions = words.select(
        F.col("p_partkey").alias("brief_id"), F.col("at").cast("long").alias("place"), kind.alias("kind"), F.when((turn != 1) | (F.col("p_size") % 2 == 0), F.col("word")).alias("term_id"),
        F.when((turn == 1) & (F.col("p_size") % 3 != 0), F.col("p_brand")).alias("category_id"), F.when(F.col("p_size") == 5, " ").otherwise("named").alias("reason"), fragment.alias("fragment"),
    )
    terms = words.where("word not like 'c%'").select(F.col("word").alias("term_id"))
    categories = parts.where("p_brand not like '%3'").select(F.col("p_brand").alias("category_id"))
    return briefs.terminology_problems(held, mentions, terms, categories, {"terms": "1", "taxonomy": "2"})


def critique_check(spark: S, d: str) -> DataFrame:
    """Orders as notes on the suppliers and parts of their lines; every fifth supplier is no event any more, some parts are no source."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    action = F.when(F.col("o_totalprice") < 5000, " ").otherwise("checked")
    resolution = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "unresolved").otherwise("open")
    notes = orders.select(F.col("o_orderkey").alias("note_id"), F.col("o_orderpriority").alias("issue"), action.alias("action"), resolution.alias("resolution"), F.lit("reason").alias("resolution_reason"))
    notes = notes.unionByName(notes.join(orders.where("o_totalprice > 480000").select(F.col("o_orderkey").alias("note_id")), "note_id", "left_semi"))
    target = lambda kind, c: lines.select(F.col("l_orderkey").alias("note_id"), F.lit(kind).alias("kind"), F.col(c).alias("target"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("event_id"))
    reviewed = suppliers.where("event_id % 3 = 0").select("event_id", F.col("event_id").alias("source_id"))
    sources = table(spark, d, "part").where("p_size <> 3").select(F.col("p_partkey").alias("source_id"))
    return briefs.critique_problems(notes, target("source", "l_partkey").unionByName(target("event", "l_suppkey")), reviewed, suppliers.where("event_id % 5 <> 0"), sources, 1)


def source_list(spark: S, d: str) -> DataFrame:
    """Sources and languages of the documents that are included."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    held = docs.select(F.col("doc_id").alias("publication_id"), "source", F.col("lang").alias("url"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"))
    return briefs.sources(held)[0]


def archive_period(spark: S, d: str) -> DataFrame:
    return briefs.period(table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate")), "day", "l_returnflag", "l_linestatus")


def text_rules(spark: S, d: str) -> DataFrame:
    """What is wrong with each document's text as a text, an excerpt and a category."""
    return table(spark, d, "documents").select("doc_id", *(briefs.text_problem(F.col("text"), kind).alias(kind) for kind in briefs.LIMITS))


def publication_limits(spark: S, d: str) -> DataFrame:
    """The limitations of each document, sorted, and its marks in their order, each once."""
    marks = F.array("lang", "source", "lang")
    dated = F.when(F.col("doc_id") % 4 == 0, "no date").when(F.col("doc_id") % 4 == 1, "")
    return table(spark, d, "documents").select("doc_id", F.array_join(briefs.limitations(marks, dated), ",").alias("limits"), F.array_join(briefs.distinct_in_order(marks), ",").alias("marks"))


def vector_literals(spark: S, d: str) -> DataFrame:
    """Embeddings in steps of 1/256 as text."""
    steps = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256) / 256)
    return table(spark, d, "embeddings").select("vec_id", vectors.literal(steps).alias("literal"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_controls, graph_snapshot, sheet_checks, dictionary_scan, brief_terminology, critique_check,
        source_list, archive_period, text_rules, publication_limits, vector_literals,
    )
}

SQL = {
    "graph_controls": """
WITH o AS (SELECT o_orderkey, o_custkey, c_custkey, o_orderstatus = 'P' AS lost, o_orderpriority = '1-URGENT' AS renamed FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
a AS (
  SELECT 'linked c' || c.c_custkey AS id, count(o_orderkey) AS expected, count(o_orderkey) FILTER (NOT lost) AS actual, count(o_orderkey) FILTER (lost OR renamed) AS missing,
    count(o_orderkey) FILTER (renamed AND NOT lost) AS unexpected FROM customer c LEFT JOIN o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey
  UNION ALL SELECT 'path log l' || l_orderkey || '/' || l_linenumber, count(c_custkey), count(c_custkey) FILTER (NOT lost), count(c_custkey) FILTER (lost OR renamed), count(c_custkey) FILTER (renamed AND NOT lost)
    FROM l LEFT JOIN o ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber
  UNION ALL SELECT 'key bore ' || o_orderkey, 1, (NOT renamed)::INT, renamed::INT, 0 FROM o
  UNION ALL SELECT 'count ' || unnest(['Well', 'Wellbore', 'WellLog', 'Rig']), 1, 1, 0, 0)
SELECT id, missing = 0 AND unexpected = 0 AS passed, expected, actual, missing, unexpected FROM a""",
    "graph_snapshot": """
WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem)
SELECT 'nodes' AS kind, '{"key":"c' || c_custkey || '","label":"Well","properties":{"name":"' || c_name || '"}}' AS line FROM customer
UNION ALL SELECT 'nodes', '{"key":"o' || o_orderkey || '","label":"Wellbore","properties":{"name":"bore ' || o_orderkey || CASE WHEN o_orderpriority = '1-URGENT' THEN ' new' ELSE '' END || '","status":"' || o_orderstatus || '"}}' FROM orders
UNION ALL SELECT 'nodes', '{"key":"l' || o || '/' || n || '","label":"WellLog","properties":{"name":"log l' || o || '/' || n || '"}}' FROM l
UNION ALL SELECT 'edges', '{"end_key":"o' || o || '","start_key":"l' || o || '/' || n || '","type":"BELONGS_TO_WELLBORE"}' FROM l
UNION ALL SELECT 'edges', '{"end_key":"c' || o_custkey || '","start_key":"o' || o_orderkey || '","type":"BELONGS_TO_WELL"}' FROM orders WHERE o_orderstatus <> 'P'""",
    "sheet_checks": """
WITH o AS (SELECT CAST(floor(o_custkey / 50) AS BIGINT) AS g, o_orderstatus <> 'P' AS kept, CAST(o_totalprice AS DECIMAL(18,2)) AS oil FROM orders),
s AS (SELECT g, count(*) FILTER (kept) AS n, CAST(sum(oil) FILTER (kept) AS DOUBLE) AS oil, CASE WHEN g % 3 = 1 THEN 'header' WHEN g % 5 = 2 THEN 'count' END AS code FROM o GROUP BY g)
SELECT 'sheet ' || g AS path, CASE WHEN code IS NULL THEN n END AS rows, CASE WHEN code IS NULL THEN oil END AS oil, code FROM s WHERE code IS NOT NULL OR n > 0
UNION ALL SELECT 'sheet ' || (max(g) + 1), NULL, NULL, 'missing' FROM o""",
    "dictionary_scan": """
WITH p AS (SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS g, p_partkey AS k FROM part),
s AS (SELECT g, count(*) AS n, count(DISTINCT k % 40) < count(*) AS again, bool_or(k % 50 = 7) AS empty FROM p GROUP BY g),
c AS (SELECT g, n, CASE WHEN g % 6 IN (1, 4, 5) OR (g % 6 = 3 AND empty) THEN 'INVALID_INPUT' WHEN g % 6 = 2 AND again THEN 'DUPLICATE_ID' END AS code FROM s)
SELECT 'terms ' || g AS path, CASE WHEN code IS NULL THEN n END AS entries, code FROM c
UNION ALL SELECT 'terms ' || (max(g) + 1), NULL, 'MISSING_FILE' FROM c""",
    "brief_terminology": """
WITH w AS (SELECT p_partkey, p_size, p_brand, p_name, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS place, unnest(string_split(p_name, ' ')) AS word FROM part),
t AS (SELECT DISTINCT word FROM w WHERE word NOT LIKE 'c%'), c AS (SELECT DISTINCT p_brand FROM part WHERE p_brand NOT LIKE '%3'),
m AS (SELECT *, (p_partkey + place) % 4 AS turn, word IN (SELECT word FROM t) AS term, p_brand IN (SELECT p_brand FROM c) AS brand FROM w),
j AS (SELECT p_partkey, place, CASE WHEN p_size = 5 THEN 'INVALID_INPUT'
  WHEN turn = 1 AND p_size % 2 <> 0 AND p_size % 3 = 0 THEN 'INVALID_INPUT'
  WHEN (turn <> 1 OR p_size % 2 = 0) AND NOT term THEN 'UNKNOWN_ID' WHEN turn = 1 AND p_size % 3 <> 0 AND NOT brand THEN 'UNKNOWN_ID'
  WHEN turn > 1 AND p_size = 4 AND NOT contains(p_name, upper(word)) THEN 'INVALID_EVIDENCE' END AS code FROM m)
SELECT p_partkey AS brief_id, place, code FROM j WHERE code IS NOT NULL
UNION ALL SELECT p_partkey, NULL, 'VERSION_MISMATCH' FROM part WHERE p_size = 8 OR (p_size = 7 AND upper(p_name) <> p_name)""",
    "critique_check": """
WITH s AS (SELECT p_partkey FROM part WHERE p_size <> 3), e AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0), r AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0),
n AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_totalprice > 480000),
f AS (
  SELECT 'repeated_note' AS rule, o_orderkey::VARCHAR AS subject FROM n GROUP BY o_orderkey HAVING count(*) > 1
  UNION ALL SELECT 'blank_text', o_orderkey::VARCHAR FROM n WHERE o_totalprice < 5000
  UNION ALL SELECT 'resolution', o_orderkey::VARCHAR FROM n WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL SELECT 'unknown_note', l_orderkey::VARCHAR FROM lineitem, range(2) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'unknown_source', l_orderkey || ':' || l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM s)
  UNION ALL SELECT 'unknown_event', l_orderkey || ':' || l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM e) AND l_suppkey NOT IN (SELECT s_suppkey FROM r)
  UNION ALL SELECT 'removed_event', l_orderkey || ':' || l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM e) AND l_suppkey IN (SELECT s_suppkey FROM r)
    AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT 'reviewed_source', s_suppkey || ':' || s_suppkey FROM r WHERE s_suppkey NOT IN (SELECT p_partkey FROM s))
SELECT 'NEWS_CRITIQUE_INVALID' AS code, rule, subject FROM f""",
    "source_list": "SELECT source, lang AS url, count(*) AS publications, min(doc_id) AS first FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source, lang",
    "archive_period": "SELECT l_returnflag, l_linestatus, min(l_shipdate)::DATE AS start, max(l_shipdate)::DATE AS \"end\", count(*) AS publications FROM lineitem GROUP BY 1, 2",
    "text_rules": """
WITH t AS (SELECT doc_id, text, regexp_replace(text, '^[\\s\\x0b\\p{Z}\\x1c-\\x1f\\x{85}]+|[\\s\\x0b\\p{Z}\\x1c-\\x1f\\x{85}]+$', '', 'g') AS bare FROM documents),
c AS (SELECT doc_id, length(text) AS n, CASE WHEN text IS NULL THEN 'missing' WHEN bare = '' THEN 'blank' WHEN contains(text, chr(0)) THEN 'nul' WHEN bare <> text THEN 'untrimmed' END AS code FROM t)
SELECT doc_id, coalesce(code, CASE WHEN n > 4000 THEN 'too_long' END) AS text, coalesce(code, CASE WHEN n > 12000 THEN 'too_long' END) AS excerpt, coalesce(code, CASE WHEN n > 200 THEN 'too_long' END) AS category FROM c""",
    "publication_limits": """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([lang, source, CASE WHEN doc_id % 4 = 0 THEN 'no date' END], lambda x: x IS NOT NULL))), ',') AS limits,
  concat_ws(',', lang, CASE WHEN source IS DISTINCT FROM lang THEN source END) AS marks FROM documents""",
    "vector_literals": "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: coalesce(CAST(floor(x::DOUBLE * 256) / 256 AS VARCHAR), 'null')), ',') || ']' AS literal FROM embeddings",
}
