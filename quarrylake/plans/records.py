"""Queries over records of many kinds: manifests, packages, activity files, catalogues, documents, web responses, ontologies,
facts, collections, archives, transcripts and streams, with the star schema and the text tables in these roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators import activities, graph, news, search, tabular, vectors
from quarrylake.plans.graphs import _edges, _nodes
from quarrylake.sources import files
from quarrylake.storage import scratch_path, stash, table
from quarrylake.streaming import telemetry

S = SparkSession


def kind_detect(spark: S, d: str) -> DataFrame:
    """Record types by kind and id: the id's type must be that of the kind."""
    kinds = F.element_at(F.array(*map(F.lit, ("Well", "Wellbore", "WellLog", "Seismic"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    held = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("osdu:wks:master-data--"), kinds, F.lit(":1.0.0")).alias("kind"), F.concat(F.lit("p:master-data--"), F.when(F.col("c_custkey") % 3 == 0, "Well").otherwise(kinds), F.lit(":"), F.col("c_custkey")).alias("id"))
    of_kind = F.regexp_extract("kind", r"^[\w.-]+:wks:[\w-]+--([A-Za-z]+):[0-9.]+$", 1)
    code = tabular.first_failure([("out_of_scope", ~of_kind.isin("Well", "Wellbore", "WellLog")), ("type_mismatch", graph.parse_id(F.col("id"))["type"] != of_kind)])
    return held.select("c_custkey", code.alias("problem"))


def graph_build_report(spark: S, d: str) -> DataFrame:
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    good, issues = graph.resolve_edges(edges.where("type = 'OF_WELL'"), nodes.where("not (label = 'Well' and key = 'w3')"), "Wellbore", "Well")
    seen = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes_seen").alias("measure"), "n")
    accepted = good.agg(F.count("*").alias("n")).select(F.lit("edges_accepted").alias("measure"), "n")
    return seen.unionByName(accepted).unionByName(issues.agg(F.count("*").alias("n")).select(F.lit("edges_rejected").alias("measure"), "n"))


def graph_entity_enrich(spark: S, d: str) -> DataFrame:
    bores = table(spark, d, "supplier").select("s_suppkey", "s_name")
    places = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select("s_suppkey", (F.col("s_suppkey") % 180).alias("lon"), (F.col("s_suppkey") % 90).alias("lat"))
    return bores.join(places, "s_suppkey", "left").select("s_suppkey", "s_name", F.when(F.col("lon").isNotNull(), F.format_string("POINT (%d %d)", "lon", "lat")).alias("wkt"))


def package_validate(spark: S, d: str) -> DataFrame:
    rec = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("uid"), F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("a"), F.date_add(F.to_date("l_shipdate"), (F.col("l_linenumber") - 2).cast("int")).alias("b"))
    known = table(spark, d, "supplier").where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("entity")).withColumn("there", F.lit(True))
    code = tabular.first_failure([("unknown_entity", F.col("there").isNull()), ("bad_period", F.col("a") >= F.col("b"))])
    return rec.join(known, "entity", "left").groupBy(code.alias("problem")).agg(F.count("*").alias("n"))


def package_reconcile(spark: S, d: str) -> DataFrame:
    """The loaded totals of each entity against those of the package, within a relative tolerance."""
    totals = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v"), F.count("*").alias("n"))
    package = totals.where("l_suppkey % 7 <> 0").select("l_suppkey", F.col("v").alias("wanted"))
    live = totals.where("l_suppkey % 11 <> 0").select("l_suppkey", (F.col("v") + F.when(F.col("l_suppkey") % 13 == 0, 0.5).otherwise(0.0)).alias("found"))
    off = F.abs(F.col("found") - F.col("wanted")) > F.greatest(F.lit(1e-6), F.abs("wanted") * 1e-12)
    code = tabular.first_failure([("missing", F.col("found").isNull()), ("extra", F.col("wanted").isNull()), ("differs", off)])
    return package.join(live, "l_suppkey", "full").select("l_suppkey", "wanted", "found", code.alias("problem"))


def csv_row_validation(spark: S, d: str) -> DataFrame:
    """Rows of an activity file by the first rule that they break."""
    key = F.col("p_partkey")
    ident = F.when(key % 17 == 0, F.lit(" ")).when(key % 5 == 0, F.concat(F.lit(" a"), key - 1, F.lit(" "))).otherwise(F.concat(F.lit("a"), key))
    volume = F.when(key % 7 == 0, "1,5").when(key % 11 == 0, "nan").when(key % 13 == 0, "1e5").otherwise(F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", ident.alias("activity_id"), volume.alias("volume"), F.when(key % 19 != 0, F.col("p_brand")).alias("measurement"))
    marked = tabular.mark_later(rows, "activity_id", "p_partkey", "later")
    checks = [("blank_id", F.trim("activity_id") == ""), ("duplicate_id", F.col("later")), ("bad_number", ~F.col("volume").rlike(tabular.NUMERIC)), ("blank_measurement", F.col("measurement").isNull())]
    return marked.select("p_partkey", tabular.first_failure(checks).alias("problem"))


def activity_file_checks(spark: S, d: str) -> DataFrame:
    """Rows of an activity file, made from parts, by the first rule that they break."""
    key = F.col("p_partkey")
    quoted = lambda c: F.expr(f"substring(to_json(named_struct('x', {c})), 6, length(to_json(named_struct('x', {c}))) - 6)")
    structure = F.when(key % 13 == 0, "[broken").when(key % 17 == 0, '[["b","t","1",2]]').when(key % 19 == 0, '{"a":1}')
    structure = structure.otherwise(F.concat(F.lit("[["), quoted("p_brand"), F.lit(","), quoted("p_type"), F.lit(","), F.col("p_size") % 3 + 1, F.lit(",0]]")))
    edges = F.when(key % 23 == 0, '[["a1","XX",1]]').when(key % 41 == 0, "").otherwise(F.concat(F.lit('[["a'), key - 1, F.lit('","FS",'), F.col("p_size"), F.lit("]]")))
    unit = F.when(key % 43 == 0, '{"code":"u"}').otherwise(F.concat(F.lit('{"code":'), quoted("p_brand"), F.lit(',"name":'), quoted("p_type"), F.lit(',"measurement":"m"}')))
    cells = F.array(
        F.when(key % 29 == 0, F.concat(F.lit(" a"), key - 1, F.lit(" "))).otherwise(F.concat(F.lit("a"), key)), F.when(key % 37 == 0, " ").otherwise(F.col("p_name")),
        F.when(key % 7 == 0, "1,5").when(key % 11 == 0, "1e999").otherwise(F.col("p_size").cast("string")), F.col("p_brand"), structure, edges, unit,
    )
    rows = table(spark, d, "part").select("p_partkey", F.when(key % 31 == 0, F.slice(cells, 1, 6)).otherwise(cells).alias("cells"))
    return activities.row_problems(rows, list(activities.COLUMNS), order="p_partkey").select("p_partkey", "problem")


def _vowels(texts: list[str]) -> list[list[float]]:
    return [[float(t.count(c)) for c in "aeiou"] for t in texts]


def embed_batch(spark: S, d: str) -> DataFrame:
    """Activity names embedded in batches by a model that is handed in; here one that counts vowels."""
    held = vectors.embed(table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.lower("p_name")).alias("name")), "name", _vowels, 5)
    return held.select("p_partkey", *(F.get("embedding", F.lit(k)).alias(c) for k, c in enumerate(("a", "e", "i", "o", "u"))), vectors.sound(F.col("embedding"), 5).alias("sound"))


def csv_strict_rows(spark: S, d: str) -> DataFrame:
    """Cells of an activity file typed or refused, with nested cells read from JSON."""
    cell = F.when(F.col("p_partkey") % 10 == 0, F.lit("[broken")).otherwise(F.concat(F.lit('[{"code":"'), F.col("p_brand"), F.lit('","level":'), F.col("p_size") % 3 + 1, F.lit("}]")))
    rows = table(spark, d, "part").select("p_partkey", F.from_json(cell, "array<struct<code:string,level:int>>").alias("s"))
    return rows.select("p_partkey", F.get("s.code", F.lit(0)).alias("code"), F.get("s.level", F.lit(0)).alias("level"), F.get("s.level", F.lit(0)).isNull().alias("refused"))


def csv_project_dictionaries(spark: S, d: str) -> DataFrame:
    """Unknown names and units are errors, unknown pairs only warn."""
    rows = table(spark, d, "part").select(F.col("p_type").alias("name"), F.concat(F.lit("u"), F.col("p_size") % 6).alias("unit"))
    known = table(spark, d, "part").where("p_partkey % 3 = 0 and p_size % 6 < 5").select(F.col("p_type").alias("name"), F.concat(F.lit("u"), F.col("p_size") % 6).alias("unit"))
    names = tabular.unknown_values(rows, ["name"], known).select(F.lit("error").alias("severity"), F.col("name").alias("value"))
    units = tabular.unknown_values(rows, ["unit"], known).select(F.lit("error").alias("severity"), F.col("unit").alias("value"))
    pairs = tabular.unknown_values(rows, ["name", "unit"], known).select(F.lit("warning").alias("severity"), F.concat_ws("/", "name", "unit").alias("value"))
    return names.unionByName(units).unionByName(pairs)


def catalogue_load(spark: S, d: str) -> DataFrame:
    """A catalogue written by category and read back with the query texts of its names."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.concat(F.lit("query: "), F.concat_ws(" || ", "p_name", "p_brand")).alias("passage"))
    path = scratch_path(spark, "catalogue")
    part.repartition("p_brand").write.partitionBy("p_brand").option("maxRecordsPerFile", 10_000).parquet(path)
    return spark.read.parquet(path).select("p_partkey", "passage", F.col("p_brand").cast("string").alias("p_brand"), F.split_part(F.concat("p_name", F.lit("&&x")), F.lit("&&"), F.lit(1)).alias("prefix"))


def mapping_shape_check(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("v", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(vectors.sound(F.col("v"), 64), 1)).alias("sound"))


def document_json_fragments(spark: S, d: str) -> DataFrame:
    """Items of JSON documents: their text and the rest as metadata."""
    doc = F.concat(F.lit('[{"text":"t'), F.col("event_id"), F.lit('","n":1},'), F.col("props"), F.lit("]"))
    items = table(spark, d, "events").select("event_id", F.posexplode(F.from_json(doc, "array<struct<text:string,n:int,k:int>>")).alias("at", "i"))
    return items.select("event_id", F.concat(F.lit("item:"), F.col("at") + 1).alias("locator"), F.coalesce("i.text", F.lit("")).alias("text"), F.col("i.k").alias("k"))


def document_csv_fragments(spark: S, d: str) -> DataFrame:
    row = table(spark, d, "events").select("event_id", F.concat(F.lit("row:"), F.col("event_id") + 2).alias("locator"), F.array(F.lit("type"), F.lit("user")).alias("h"), F.array("event_type", F.col("user_id").cast("string")).alias("c"))
    return row.select("event_id", "locator", F.array_join(F.zip_with("h", "c", lambda a, b: F.concat(a, F.lit(": "), b)), "\n").alias("text"))


def record_lookup(spark: S, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    found = table(spark, d, "documents").groupBy("doc_id").agg(F.count("*").alias("n"))
    return asked.distinct().join(found, "doc_id", "left").select("doc_id", F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("outcome"))


def web_response_rows(spark: S, d: str) -> DataFrame:
    """At most five rows of each response, snippets cut, with dates inside the window; a row without a date fails it."""
    p = table(spark, d, "pages").select((F.col("page_id") % 20).alias("response"), F.col("page_id").alias("pos"), "url", F.substring("html", 1, 2000).alias("content"), F.when(F.col("page_id") % 7 != 0, F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 40).cast("int"))).alias("day"))
    kept = p.where("day between '2024-01-05' and '2024-01-30'").withColumn("k", F.row_number().over(W.partitionBy("response").orderBy("pos"))).where("k <= 5")
    return kept.select("response", "k", "url", F.sha2("content", 256).alias("content_sha"), "day")


def bundle_validate(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, "0").otherwise(F.sha2("url", 256)).alias("source_id"), "url", F.when(F.col("page_id") % 8 == 0, "2024-02-30").otherwise("2024-02-28").alias("day"))
    exact = F.date_format(F.try_to_date("day"), "yyyy-MM-dd")
    code = tabular.first_failure([("bad_id", F.col("source_id") != F.sha2("url", 256)), ("bad_date", ~F.coalesce(exact == F.col("day"), F.lit(False)))])
    return p.select("page_id", code.alias("problem"))


def ontology_reference_check(spark: S, d: str) -> DataFrame:
    """Relations whose ends are no declared type, with nations and regions as types."""
    types = table(spark, d, "region").select(F.col("r_regionkey").alias("t"))
    rel = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.col("n_regionkey"), F.col("n_nationkey"))).alias("t"))
    return rel.join(types, "t", "left_anti").select("n_nationkey", F.col("t").alias("unknown_type"))


def fact_batch_pinning(spark: S, d: str) -> DataFrame:
    pin = F.sha2(F.concat(F.lit("v"), F.col("doc_id") % 3), 256)
    return table(spark, d, "labels").groupBy(pin.alias("pin")).agg(F.count("*").alias("facts"), F.min("doc_id").alias("first"))


def collection_inspect(spark: S, d: str) -> DataFrame:
    found = None
    for name in ("documents", "labels", "benchmark", "pages"):
        df = table(spark, d, name)
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(",".join(df.columns)).alias("columns"))
        found = one if found is None else found.unionByName(one)
    return found


def collection_join(spark: S, d: str) -> DataFrame:
    for name in ("documents", "labels"):
        table(spark, d, name).createOrReplaceTempView(f"ql_{name}")
    return spark.sql("WITH good AS (SELECT doc_id FROM ql_labels WHERE quality = :q) SELECT lang, count(*) AS n FROM ql_documents WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY lang", args={"q": 1})


def collection_source_refs(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("scum")))
    return docs.select("source", search.fragment_id(F.col("source"), F.lit("document"), F.col("text")).alias("fragment_id")).distinct()


def lexical_candidates(spark: S, d: str) -> DataFrame:
    """Documents that share a word of at least three letters with a term, and the words matched."""
    terms = spark.range(1).select(F.explode(F.array(*map(F.lit, ("scum", "idiot", "moron", "of")))).alias("word")).where("length(word) >= 3")
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("word"))
    return words.join(F.broadcast(terms), "word").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("word")), ",").alias("matched"))


def news_validate(spark: S, d: str) -> DataFrame:
    decisions = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"), (F.col("toxic") == 1).alias("has_event"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n"))
    code = tabular.first_failure([("unknown_source", F.col("source").isNull()), ("event_of_excluded", (F.col("decision") == "exclude") & F.col("has_event")), ("blank_text", F.col("n") == 0), ("short_text", F.col("n") < 60)])
    return decisions.join(docs, "doc_id", "left").groupBy(code.alias("problem")).agg(F.count("*").alias("n"))


def archive_analysis_validate(spark: S, d: str) -> DataFrame:
    """Quotes of benchmark items in the documents that cite them, found by the quote's first line."""
    quotes = table(spark, d, "benchmark").select("item_id", F.substring_index("text", "\n", 1).alias("quote"), F.col("item_id").alias("doc_id"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return quotes.join(docs, "doc_id", "left").select("item_id", F.when(F.col("text").isNull(), "unknown_publication").when(~F.contains("text", "quote"), "absent_quote").alias("problem"))


def publication_rows(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    decided = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"))
    return docs.join(decided, "doc_id", "left").select("doc_id", "source", F.coalesce("decision", F.lit("undecided")).alias("decision"))


def terminology_checks(spark: S, d: str) -> DataFrame:
    """Relations of terms: unknown target, self relation, and keywords that their quote does not hold as a word."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("term"), (F.col("p_partkey") + F.when(F.col("p_size") == 2, 0).when(F.col("p_size") == 3, 1 << 40).otherwise(-1)).alias("target"), F.substring_index("p_name", " ", 1).alias("keyword"), F.when(F.col("p_size") == 4, "none").otherwise(F.col("p_name")).alias("quote"))
    known = t.select(F.col("term").alias("target")).withColumn("there", F.lit(True))
    inside = F.exists(F.split("quote", " "), lambda w: w == F.col("keyword"))
    code = tabular.first_failure([("self", F.col("term") == F.col("target")), ("unknown_target", F.col("there").isNull()), ("keyword_not_in_quote", ~inside)])
    return t.join(known, "target", "left").groupBy(code.alias("problem")).agg(F.count("*").alias("n"))


def answer_grading(spark: S, d: str) -> DataFrame:
    """Which expected tokens stand in an answer as whole words."""
    c = table(spark, d, "conversations")
    words = search.tokens(F.col("text"))
    return c.select("conv_id", "turn", F.size(F.array_intersect(words, F.array(*map(F.lit, ("the", "of", "la", "der"))))).alias("found"), F.contains(F.lower("text"), F.lit("insufficient data")).alias("insufficient"))


def telemetry_batch(spark: S, d: str) -> DataFrame:
    """Snapshots of twenty points, and each missing field by path."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 20).alias("snapshot"), F.struct("event_id", F.when(F.col("event_id") % 6 != 0, F.lit("bar")).alias("unit")).alias("p"))
    snaps = e.groupBy("snapshot").agg(F.array_sort(F.collect_list("p")).alias("points"))
    gaps = F.filter(F.transform("points", lambda p, i: F.when(p["unit"].isNull(), F.concat(F.lit("points["), i, F.lit("].unit")))), lambda x: x.isNotNull())
    return snaps.select("snapshot", F.array_join(gaps, ";").alias("missing"), F.when(F.size(gaps) > 0, "incomplete").otherwise("ok").alias("status"))


def segy_headers(spark: S, d: str) -> DataFrame:
    """Headers of one binary file for each nation, built from its key, written and read back."""
    path = scratch_path(spark, "segy")
    field = lambda v: F.unhex(F.lpad(F.hex(v), 4, "0")).cast("string")
    fill = lambda n: F.repeat(F.lit("A"), n)
    key = F.col("n_nationkey").cast("long")
    body = F.concat(fill(3216), field(key * 100), fill(2), field(key + 1000), fill(2), field(F.lit(1)), fill(274), field(F.when(key % 5 == 0, 512).otherwise(256)), fill(98))
    rows = table(spark, d, "nation").select("n_nationkey", F.when(key % 7 == 0, fill(50)).otherwise(body).alias("value"))
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey").option("lineSep", "A").option("encoding", "ISO-8859-1").text(path)
    found = files.segy_headers(files.scan(spark, path, "part-*"))
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "status", "sample_interval", "samples", "revision")


def osdu_manifest(spark: S, d: str) -> DataFrame:
    """Records of manifests written as one JSON list for each region."""
    path = scratch_path(spark, "manifest")
    n = table(spark, d, "nation").select("n_regionkey", F.to_json(F.struct(F.concat(F.lit("p:master-data--Well:"), "n_nationkey").alias("id"), F.lit("osdu:wks:master-data--Well:1.0.0").alias("kind"), F.struct(F.col("n_name").alias("FacilityName")).alias("data"))).alias("j"))
    lists = n.groupBy("n_regionkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    lists.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return files.manifest_records(files.scan(spark, path, "part-*")).select("id", "kind", F.element_at("data", "FacilityName").alias("name"))


def witsml_wells(spark: S, d: str) -> DataFrame:
    """Well documents of at most ten wells each, read back; a document's status is that of its first well."""
    well = F.concat(F.lit('<well uid="'), F.col("s_suppkey"), F.lit('"><name>'), F.col("s_name"), F.lit("</name>"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit('<wellheadElevation uom="m">'), F.col("s_suppkey"), F.lit("</wellheadElevation>"))).otherwise(""), F.lit("</well>"))
    docs = table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 10).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", well.alias("xml")))).alias("w"))
    xml = F.concat(F.lit('<wells xmlns="http://www.witsml.org/schemas/1series" version="'), F.when(F.col("doc") % 4 == 0, "2.0").otherwise("1.4.1.1"), F.lit('">'), F.array_join("w.xml", ""), F.lit("</wells>"))
    held = stash(docs.select(F.concat(F.lit("wells-"), "doc").alias("path"), xml.cast("binary").alias("content")), "wells")
    return files.wells(held).select(F.col("uid").cast("long").alias("s_suppkey"), "name", "elevation", "uom", "status")


QUERIES = {f.__name__: f for f in (kind_detect, graph_build_report, graph_entity_enrich, package_validate, package_reconcile, csv_row_validation, activity_file_checks, embed_batch, csv_strict_rows, csv_project_dictionaries, catalogue_load, mapping_shape_check, document_json_fragments, document_csv_fragments, record_lookup, web_response_rows, bundle_validate, ontology_reference_check, fact_batch_pinning, collection_inspect, collection_join, collection_source_refs, lexical_candidates, news_validate, archive_analysis_validate, publication_rows, terminology_checks, answer_grading, telemetry_batch, segy_headers, osdu_manifest, witsml_wells)}

SQL = {
    "kind_detect": """
WITH c AS (SELECT c_custkey, ['Well', 'Wellbore', 'WellLog', 'Seismic'][c_custkey % 4 + 1] AS k FROM customer)
SELECT c_custkey, CASE WHEN k = 'Seismic' THEN 'out_of_scope' WHEN c_custkey % 3 = 0 AND k <> 'Well' THEN 'type_mismatch' END AS problem FROM c""",
    "graph_build_report": """
WITH logs AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT 'nodes_seen' AS measure, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM logs) AS n
UNION ALL SELECT 'edges_accepted', (SELECT count(*) FROM supplier WHERE s_nationkey <> 3) UNION ALL SELECT 'edges_rejected', (SELECT count(*) FROM supplier WHERE s_nationkey = 3)""",
    "graph_entity_enrich": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 <> 0 THEN 'POINT (' || s_suppkey % 180 || ' ' || s_suppkey % 90 || ')' END AS wkt FROM supplier",
    "package_validate": "SELECT CASE WHEN l_suppkey % 6 = 0 THEN 'unknown_entity' WHEN l_linenumber <= 2 THEN 'bad_period' END AS problem, count(*) AS n FROM lineitem GROUP BY 1",
    "package_reconcile": """
WITH t AS (SELECT l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
p AS (SELECT l_suppkey, v AS wanted FROM t WHERE l_suppkey % 7 <> 0),
l AS (SELECT l_suppkey, v + CASE WHEN l_suppkey % 13 = 0 THEN 0.5 ELSE 0 END AS found FROM t WHERE l_suppkey % 11 <> 0)
SELECT l_suppkey, wanted, found, CASE WHEN found IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'extra' WHEN abs(found - wanted) > greatest(1e-6, abs(wanted) * 1e-12) THEN 'differs' END AS problem
FROM p FULL JOIN l USING (l_suppkey)""",
    "activity_file_checks": """
WITH p AS (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 29 = 0 THEN 'a' || (p_partkey - 1) ELSE 'a' || p_partkey END AS id, CASE WHEN p_partkey % 37 = 0 THEN ' ' ELSE p_name END AS name,
         CASE WHEN p_partkey % 7 = 0 THEN '1,5' WHEN p_partkey % 11 = 0 THEN '1e999' ELSE CAST(p_size AS VARCHAR) END AS volume,
         CASE WHEN p_partkey % 13 = 0 THEN '[broken' WHEN p_partkey % 17 = 0 THEN '[["b","t","1",2]]' WHEN p_partkey % 19 = 0 THEN '{"a":1}'
              ELSE CAST(json_array(json_array(p_brand, p_type, p_size % 3 + 1, 0)) AS VARCHAR) END AS structure,
         CASE WHEN p_partkey % 23 = 0 THEN '[["a1","XX",1]]' WHEN p_partkey % 41 = 0 THEN '' ELSE CAST(json_array(json_array('a' || (p_partkey - 1), 'FS', p_size)) AS VARCHAR) END AS edges,
         CASE WHEN p_partkey % 43 = 0 THEN '{"code":"u"}' ELSE CAST(json_object('code', p_brand, 'name', p_type, 'measurement', 'm') AS VARCHAR) END AS unit
  FROM part),
j AS (
  SELECT *, k > min(k) OVER (PARTITION BY id) AS later,
         CASE WHEN json_valid(structure) THEN structure END AS js, CASE WHEN json_valid(edges) THEN edges END AS je, CASE WHEN json_valid(unit) THEN unit END AS ju
  FROM p)
SELECT k AS p_partkey, CASE
  WHEN k % 31 = 0 THEN 'E_ROW_WIDTH' WHEN trim(name) = '' THEN 'E_REQUIRED_MISSING' WHEN later THEN 'E_DUPLICATE_ID'
  WHEN NOT regexp_full_match(volume, '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN 'E_VOLUME_INVALID' WHEN volume = '1e999' THEN 'E_VOLUME_NON_FINITE'
  WHEN js IS NULL THEN 'E_NESTED_INVALID'
  WHEN json_type(js) <> 'ARRAY' OR json_array_length(js, '$[0]') <> 4 OR json_type(js, '$[0][0]') <> 'VARCHAR' OR json_type(js, '$[0][1]') <> 'VARCHAR'
       OR json_type(js, '$[0][2]') <> 'UBIGINT' OR json_type(js, '$[0][3]') <> 'UBIGINT' THEN 'E_STRUCTURE_INVALID'
  WHEN edges <> '' AND (json_array_length(je, '$[0]') <> 3 OR json_extract_string(je, '$[0][1]') NOT IN ('FS', 'SS', 'FF', 'SF') OR json_type(je, '$[0][2]') <> 'UBIGINT') THEN 'E_EDGE_INVALID'
  WHEN json_extract_string(ju, '$.name') IS NULL OR json_extract_string(ju, '$.measurement') IS NULL THEN 'E_GRANULAR_UNIT_INVALID' END AS problem
FROM j""",
    "csv_row_validation": """
WITH r AS (
  SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'a' || (p_partkey - 1) ELSE 'a' || p_partkey END AS id,
         p_partkey % 7 = 0 OR p_partkey % 11 = 0 AS bad, p_partkey % 19 = 0 AS blank FROM part),
m AS (SELECT *, p_partkey > min(p_partkey) OVER (PARTITION BY id) AS later FROM r)
SELECT p_partkey, CASE WHEN id = '' THEN 'blank_id' WHEN later THEN 'duplicate_id' WHEN bad THEN 'bad_number' WHEN blank THEN 'blank_measurement' END AS problem FROM m""",
    "embed_batch": """
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN lower(p_name) END AS t FROM part)
SELECT p_partkey, CAST(length(t) - length(replace(t, 'a', '')) AS DOUBLE) AS a, CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) AS e,
       CAST(length(t) - length(replace(t, 'i', '')) AS DOUBLE) AS i, CAST(length(t) - length(replace(t, 'o', '')) AS DOUBLE) AS o,
       CAST(length(t) - length(replace(t, 'u', '')) AS DOUBLE) AS u, t IS NOT NULL AS sound FROM n""",
    "csv_strict_rows": "SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS code, CASE WHEN p_partkey % 10 <> 0 THEN p_size % 3 + 1 END AS level, p_partkey % 10 = 0 AS refused FROM part",
    "csv_project_dictionaries": """
WITH r AS (SELECT DISTINCT p_type AS name, 'u' || p_size % 6 AS unit FROM part), k AS (SELECT DISTINCT p_type AS name, 'u' || p_size % 6 AS unit FROM part WHERE p_partkey % 3 = 0 AND p_size % 6 < 5)
SELECT 'error' AS severity, name AS value FROM (SELECT name FROM r EXCEPT SELECT name FROM k) UNION ALL SELECT 'error', unit FROM (SELECT unit FROM r EXCEPT SELECT unit FROM k)
UNION ALL SELECT 'warning', name || '/' || unit FROM (SELECT name, unit FROM r EXCEPT SELECT name, unit FROM k)""",
    "catalogue_load": "SELECT p_partkey, 'query: ' || p_name || ' || ' || p_brand AS passage, p_brand, p_name AS prefix FROM part",
    "mapping_shape_check": "SELECT label, count(*) AS n, count(*) FILTER (WHERE vec_id % 9 <> 0) AS sound FROM embeddings GROUP BY label",
    "document_json_fragments": """
SELECT event_id, 'item:1' AS locator, 't' || event_id AS text, CAST(NULL AS INTEGER) AS k FROM events
UNION ALL SELECT event_id, 'item:2', '', CAST(json_extract(props, '$.k') AS INTEGER) FROM events""",
    "document_csv_fragments": "SELECT event_id, 'row:' || (event_id + 2) AS locator, 'type: ' || event_type || chr(10) || 'user: ' || user_id AS text FROM events",
    "record_lookup": """
WITH n AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1)
SELECT DISTINCT item_id AS doc_id, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS outcome FROM benchmark LEFT JOIN n ON n.doc_id = item_id""",
    "web_response_rows": """
WITH p AS (SELECT page_id % 20 AS response, page_id, url, sha256(left(html, 2000)) AS content_sha, DATE '2024-01-01' + CAST(page_id % 40 AS INTEGER) AS day FROM pages WHERE page_id % 7 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY response ORDER BY page_id) AS k FROM p WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-30')
SELECT response, k, url, content_sha, day FROM k WHERE k <= 5""",
    "bundle_validate": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'bad_id' WHEN page_id % 8 = 0 THEN 'bad_date' END AS problem FROM pages",
    "ontology_reference_check": """
WITH r AS (SELECT n_nationkey, n_regionkey AS t FROM nation UNION ALL SELECT n_nationkey, n_nationkey FROM nation)
SELECT n_nationkey, t AS unknown_type FROM r WHERE t NOT IN (SELECT r_regionkey FROM region)""",
    "fact_batch_pinning": "SELECT sha256('v' || doc_id % 3) AS pin, count(*) AS facts, min(doc_id) AS first FROM labels GROUP BY 1",
    "collection_inspect": """
SELECT 'documents' AS name, count(*) AS rows, 'doc_id,text,lang,source,n_chars' AS columns FROM documents UNION ALL SELECT 'labels', count(*), 'doc_id,quality,toxic' FROM labels
UNION ALL SELECT 'benchmark', count(*), 'item_id,text' FROM benchmark UNION ALL SELECT 'pages', count(*), 'page_id,url,html' FROM pages""",
    "collection_join": "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang",
    "collection_source_refs": "SELECT DISTINCT source, sha256(source || chr(0) || 'document' || chr(0) || text) AS fragment_id FROM documents WHERE contains(text, 'scum')",
    "lexical_candidates": """
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents)
SELECT doc_id, string_agg(word, ',' ORDER BY word) AS matched FROM w WHERE word IN ('scum', 'idiot', 'moron') GROUP BY doc_id""",
    "news_validate": """
SELECT CASE WHEN d.source IS NULL THEN 'unknown_source' WHEN quality <> 1 AND toxic = 1 THEN 'event_of_excluded' WHEN length(text) = 0 THEN 'blank_text' WHEN length(text) < 60 THEN 'short_text' END AS problem, count(*) AS n
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1""",
    "archive_analysis_validate": """
SELECT item_id, CASE WHEN d.text IS NULL THEN 'unknown_publication' WHEN NOT contains(d.text, string_split(b.text, chr(10))[1]) THEN 'absent_quote' END AS problem
FROM benchmark b LEFT JOIN documents d ON d.doc_id = item_id""",
    "publication_rows": "SELECT d.doc_id, source, CASE WHEN quality = 1 THEN 'include' WHEN quality IS NOT NULL THEN 'exclude' ELSE 'undecided' END AS decision FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "terminology_checks": """
WITH t AS (SELECT p_partkey AS term, p_partkey + CASE p_size WHEN 2 THEN 0 WHEN 3 THEN 1099511627776 ELSE -1 END AS target, p_size FROM part)
SELECT CASE WHEN t.term = t.target THEN 'self' WHEN k.term IS NULL THEN 'unknown_target' WHEN t.p_size = 4 THEN 'keyword_not_in_quote' END AS problem, count(*) AS n
FROM t LEFT JOIN t k ON k.term = t.target GROUP BY 1""",
    "answer_grading": """
SELECT conv_id, turn, len(list_intersect(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['the', 'of', 'la', 'der'])) AS found, contains(lower(text), 'insufficient data') AS insufficient FROM conversations""",
    "telemetry_batch": """
WITH e AS (SELECT event_id // 20 AS snapshot, event_id, row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) - 1 AS i FROM events),
g AS (SELECT snapshot, coalesce(string_agg('points[' || i || '].unit', ';' ORDER BY i) FILTER (WHERE event_id % 6 = 0), '') AS missing FROM e GROUP BY snapshot)
SELECT snapshot, missing, CASE WHEN missing = '' THEN 'ok' ELSE 'incomplete' END AS status FROM g""",
    "segy_headers": """
SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 'truncated' WHEN n_nationkey % 5 = 0 THEN 'unsupported' ELSE 'ok' END AS status,
       CASE WHEN n_nationkey % 7 <> 0 THEN n_nationkey * 100 END AS sample_interval, CASE WHEN n_nationkey % 7 <> 0 THEN n_nationkey + 1000 END AS samples,
       CASE WHEN n_nationkey % 7 = 0 THEN NULL WHEN n_nationkey % 5 = 0 THEN 512 ELSE 256 END AS revision FROM nation""",
    "osdu_manifest": "SELECT 'p:master-data--Well:' || n_nationkey AS id, 'osdu:wks:master-data--Well:1.0.0' AS kind, n_name AS name FROM nation",
    "witsml_wells": """
SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey::DOUBLE END AS elevation, CASE WHEN s_suppkey % 3 <> 0 THEN 'm' END AS uom,
       CASE WHEN s_suppkey // 10 % 4 = 0 THEN 'unsupported' WHEN min(s_suppkey) OVER (PARTITION BY s_suppkey // 10) % 3 = 0 THEN 'incomplete' ELSE 'ok' END AS status FROM supplier""",
}
