"""Queries over what is handed in and published as a whole: collections with guarded SQL, graphs kept up to date from
streams, fact batches and manifests; documents are fragments, labels observations, events changes of a graph, customers
wells, orders wellbores and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.operators import activities, collection, facts, manifest, ontology, search, vectors
from quarrylake.sources import documents, files
from quarrylake.storage import scratch_path, table
from quarrylake.streaming import graph_load, telemetry

S = SparkSession


def _fragments(spark: S, d: str) -> DataFrame:
    locator = F.concat(F.lit("document:"), F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.col("source").alias("source_id"), locator.alias("locator"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("fragment_id", search.fragment_id(F.col("source_id"), F.col("locator"), F.col("text")))


def _collection_facts(spark: S, d: str) -> DataFrame:
    """Documents and languages are entities, what a document is written in a relation, its quality an observation."""
    docs = _fragments(spark, d)
    key = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    documents = docs.select(
        F.lit("entity").alias("kind"), key.alias("id"), F.lit("document").alias("type_id"), F.to_json(F.struct("lang", "n_chars")).alias("properties"), "source_id", "fragment_id"
    )
    first = docs.groupBy("lang").agg(F.min_by(F.struct("source_id", "fragment_id"), "doc_id").alias("f"))
    languages = first.select(F.lit("entity").alias("kind"), F.concat(F.lit("lang:"), "lang").alias("id"), F.lit("language").alias("type_id"), F.lit("{}").alias("properties"), "f.source_id", "f.fragment_id")
    written = docs.select(
        F.lit("relation").alias("kind"), F.concat(F.lit("in:"), F.col("doc_id").cast("string")).alias("id"), F.lit("written_in").alias("type_id"), key.alias("source_entity_id"),
        F.lit("document").alias("source_type_id"), F.concat(F.lit("lang:"), "lang").alias("target_entity_id"), F.lit("language").alias("target_type_id"), "source_id", "fragment_id",
    )
    judged = table(spark, d, "labels").join(docs, "doc_id").select(
        F.lit("observation").alias("kind"), F.concat(F.lit("quality:"), F.col("doc_id").cast("string")).alias("id"), F.lit("quality").alias("type_id"), key.alias("subject_entity_id"),
        F.lit("document").alias("subject_type_id"), F.col("quality").cast("string").alias("value"), F.lit("{}").alias("conditions"), "source_id", "fragment_id",
    )
    every = documents.unionByName(languages).unionByName(written, allowMissingColumns=True).unionByName(judged, allowMissingColumns=True)
    return every.withColumn("unit", F.lit(None).cast("string"))


def _collection(spark: S, d: str, path: str) -> dict:
    docs = _fragments(spark, d)
    sources = docs.select("source_id").distinct().select("source_id", F.concat("source_id", F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("content_type"))
    return collection.build(spark, path, _collection_facts(spark, d), docs.select("fragment_id", "source_id", "locator", "text"), sources, {"ontology_id": "documents", "schema_version": 1})


def collection_build(spark: S, d: str) -> DataFrame:
    """Rows of each table of the collection built from the documents, and that building it again changes nothing."""
    path = scratch_path(spark, "collection")
    first, again = _collection(spark, d, path), _collection(spark, d, path)
    counts = collection.Collection(spark, path).counts
    rows = [(name, n, again["unchanged"] and again["version"] == first["version"]) for name, n in counts.items()]
    return spark.createDataFrame(rows, "name string, rows long, unchanged boolean")


def collection_guarded_sql(spark: S, d: str) -> DataFrame:
    """Guarded SQL over the whole collection: joins, a common table, json_each and parameters."""
    path = scratch_path(spark, "collection")
    _collection(spark, d, path)
    return collection.Collection(spark, path).sql(
        """WITH good AS (SELECT subject_node_id FROM observations WHERE type_id = ? AND value_json = ?)
           SELECT e.key AS property, e.value, count(*) AS n, count(DISTINCT n.source_id) AS sources
           FROM nodes n JOIN good g ON g.subject_node_id = n.node_id JOIN relations r ON r.source_node_id = n.node_id,
                LATERAL json_each(n.properties_json) e
           WHERE e.type = ? AND r.target_node_id = concat('lang:', e.value) GROUP BY e.key, e.value""",
        ["quality", "1", "text"],
    )


def collection_result(spark: S, d: str) -> DataFrame:
    """The capped result document of a query, a row for each row of it, with the number of its sources."""
    path = scratch_path(spark, "collection")
    _collection(spark, d, path)
    found = collection.Collection(spark, path).query(
        "SELECT fragment_id, source_id, locator, octet_length(text) AS bytes FROM fragments WHERE source_id >= ? ORDER BY bytes DESC, fragment_id", ["src1"], 50
    )
    rows = [(r["fragment_id"], r["source_id"], r["locator"], r["bytes"], found["truncated"], len(found["source_refs"])) for r in found["rows"]]
    return spark.createDataFrame(rows, "fragment_id string, source_id string, locator string, bytes int, truncated boolean, refs long")


def _user_nodes(batch: DataFrame) -> DataFrame:
    set_by = F.create_map(F.lit("last"), F.col("event_type"), F.concat(F.lit("did_"), F.col("event_type")), F.lit("yes"))
    users = batch.select(F.lit("User").alias("label"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), set_by.alias("properties"), F.col("event_id").alias("at"))
    kinds = batch.select(F.lit("Kind").alias("label"), F.concat(F.lit("kind:"), F.col("event_type")).alias("key"), F.create_map().cast("map<string,string>").alias("properties"), F.col("event_id").alias("at"))
    return users.unionByName(kinds)


def _user_edges(batch: DataFrame) -> DataFrame:
    return batch.select(F.lit("DID").alias("type"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("start_key"), F.concat(F.lit("kind:"), F.col("event_type")).alias("end_key"))


def graph_upsert_stream(spark: S, d: str) -> DataFrame:
    """Users and what they did, merged into a stored graph from a stream of several files, of which the second run of the same
    stream from the start changes nothing."""
    landed, path = scratch_path(spark, "landed"), scratch_path(spark, "graph")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    events.repartitionByRange(4, "event_id").write.parquet(landed)
    for run in ("first", "again"):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(landed)
        graph_load.load(stream, _user_nodes, _user_edges, path, "events", scratch_path(spark, f"marks-{run}")).awaitTermination()
    nodes, edges, _ = graph_load.graph(spark, path)
    out = edges.groupBy(F.col("start_key").alias("key")).agg(F.count("*").alias("edges"))
    return nodes.join(out, "key", "left").select("label", "key", F.element_at("properties", "last").alias("last"), F.size("properties").cast("long").alias("properties"), F.coalesce("edges", F.lit(0)).alias("edges"))


_FACT_TYPES = [("entity", "document", None, None, None, None, None), ("entity", "language", None, None, None, None, None), ("relation", "written_in", "document", "language", None, None, None), ("observation", "quality", None, None, "document", "integer", False), ("observation", "size", None, None, "document", "number", True)]
_FACT_PROPERTIES = [("entity", "document", "lang", "string", True), ("entity", "document", "chars", "integer", False), ("observation", "size", "method", "string", True)]


def fact_batch_validate(spark: S, d: str) -> DataFrame:
    """Each fact that a source hands in with the first rule it breaks: documents with properties, their languages, judgements
    and sizes. Faults stand in the table's own values: short documents have no language, junk has a number for one, and so on."""
    docs = _fragments(spark, d).withColumnRenamed("source_id", "batch")
    key = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    words = F.size(F.split("text", " "))
    lang = F.when(F.col("n_chars") < 60, "{").otherwise(F.concat(F.lit('{"lang":'), F.when(words % 11 == 0, F.col("n_chars").cast("string")).otherwise(F.concat(F.lit('"'), "lang", F.lit('"'))), F.lit(",")))
    properties = F.concat(lang, F.when(words % 13 == 0, '"letters":').otherwise('"chars":'), F.col("n_chars").cast("string"), F.when(words % 7 == 0, ".5}").otherwise("}"))
    quote = F.when(words % 17 == 0, F.concat(F.substring("text", 1, 30), F.lit("\0"))).when(words % 19 == 0, F.reverse(F.substring("text", 1, 30))).otherwise(F.substring("text", 1, 30))
    evidence = (F.when(words % 23 == 0, F.concat("batch", F.lit("x"))).otherwise(F.col("batch")).alias("source_id"), "fragment_id", quote.alias("evidence"))
    entity = docs.select("batch", F.lit("entity").alias("kind"), key.alias("id"), F.when(words % 29 == 0, "page").otherwise("document").alias("type_id"), properties.alias("properties"), *evidence)
    relation = docs.select(
        "batch", F.lit("relation").alias("kind"), F.concat(F.lit("in:"), F.col("lang"), F.lit(":"), F.col("n_chars").cast("string")).alias("id"), F.lit("written_in").alias("type_id"), key.alias("source_entity_id"),
        F.lit("document").alias("source_type_id"), F.concat(F.lit("lang:"), "lang").alias("target_entity_id"), F.when(words % 31 == 0, "document").otherwise("language").alias("target_type_id"), *evidence,
    )
    size = docs.select(
        "batch", F.lit("observation").alias("kind"), F.concat(F.lit("size:"), F.col("doc_id").cast("string")).alias("id"), F.lit("size").alias("type_id"), key.alias("subject_entity_id"), F.lit("document").alias("subject_type_id"),
        F.when(words % 5 == 0, "true").otherwise(F.col("n_chars").cast("string")).alias("value"), F.when(words % 3 != 0, "char").alias("unit"), F.when(words % 37 == 0, "{}").otherwise('{"method":"count"}').alias("conditions"), *evidence,
    )
    handed = entity.unionByName(relation, allowMissingColumns=True).unionByName(size, allowMissingColumns=True)
    judged = facts.judge(handed, spark.createDataFrame(_FACT_TYPES, facts.TYPES), spark.createDataFrame(_FACT_PROPERTIES, facts.PROPERTIES), docs.select("fragment_id", F.col("batch").alias("source_id"), "text"))
    return judged.select("batch", "kind", "id", "code", "rule")


def _manifest_files(spark: S, d: str) -> DataFrame:
    """JSON files of fifty customers each, their orders and some logs, as a list, in envelopes, and three and six levels down."""
    text = lambda c: F.col(c).cast("string")
    record = lambda i, kind, data: F.to_json(F.struct(i.alias("id"), F.lit(kind).alias("kind"), F.struct(*data).alias("data")))
    wells = table(spark, d, "customer").select(
        F.floor(F.col("c_custkey") / 50).alias("g"), record(F.concat(F.lit("osdu:master-data--Well:c"), text("c_custkey"), F.lit(":")), "osdu:wks:master-data--Well:1.0.0", [F.col("c_name").alias("FacilityName"), F.col("c_nationkey").alias("FacilityID")]).alias("j")
    )
    orders = table(spark, d, "orders").withColumn("g", F.floor(F.col("o_custkey") / 50))
    low = F.col("o_orderpriority") == "5-LOW"
    of = F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000), "Well").otherwise("Wellbore")
    name = F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 50000), " ").otherwise(F.concat(F.lit("bore "), text("o_orderkey")))
    bore_id = F.concat(F.lit("osdu:master-data--"), of, F.lit(":o"), text("o_orderkey"))
    bore_data = [name.alias("Name"), F.concat(F.lit("osdu%3Amaster-data--Well:c"), text("o_custkey"), F.lit(":")).alias("WellID"), F.col("o_totalprice").alias("SequenceNumber")]
    bores = orders.where(~low).select("g", record(bore_id, "osdu:wks:master-data--Wellbore:1.1.0", bore_data).alias("j"))
    skipped = orders.where(low).select("g", record(text("o_orderkey"), "osdu:wks:dataset--File.Generic:1.0.0", [F.col("o_orderkey").alias("Name")]).alias("j"))
    log_data = [F.concat(F.lit("log "), text("o_orderkey")).alias("Name"), F.concat(F.lit("osdu:master-data--Wellbore:o"), text("o_orderkey")).alias("WellboreID")]
    logs = orders.where(~low & (F.col("o_orderstatus") == "O")).select("g", record(F.lit(None).cast("string"), "osdu:wks:work-product-component--WellLog:1.0.0", log_data).alias("j"))
    lists = wells.unionByName(bores).unionByName(skipped).unionByName(logs).groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("l"))
    around = lambda before, after: F.concat(F.lit(before), F.col("l"), F.lit(after))
    envelope = '{"kind":"osdu:wks:Manifest:1.0.0","Data":{"x":'
    whole = F.when(F.col("g") % 4 == 0, F.col("l")).when(F.col("g") % 4 == 1, around(envelope, "}}")).when(F.col("g") % 4 == 2, around('{"a":[5,', ',"text"]}')).otherwise(around(envelope + '[{"b":{"c":', "}}]}}"))
    path = scratch_path(spark, "manifests")
    lists.select("g", whole.alias("value")).repartition("g").write.partitionBy("g").text(path)
    return files.scan(spark, path, "part-*").select("path", "content")


def manifest_walk(spark: S, d: str) -> DataFrame:
    """Each record of the manifests: what it becomes, its parent, or why it is rejected."""
    records, issues = manifest.walk(_manifest_files(spark, d))
    judged = manifest.judge(records).select("label", "key", "parent", F.size("properties").cast("long").alias("properties"), "reason")
    return judged.unionByName(issues.select(F.lit(None).cast("string").alias("label"), F.col("source").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("properties"), "reason"))


def manifest_graph_load(spark: S, d: str) -> DataFrame:
    """The report of the graph of the manifests, and what two loads of it publish."""
    built, path = manifest.build(_manifest_files(spark, d)), scratch_path(spark, "manifest-graph")
    first, again = manifest.load(spark, built, path), manifest.load(spark, built, path)
    told = [(f"published {name}", n) for name, n in first["counts"].items()] + [("second load unchanged", int(again["unchanged"]))]
    return manifest.report(built).unionByName(spark.createDataFrame(told, "measure string, n long"))


#: Days of January up to which each part of the events is delivered, and those delivered with the last part only.
_PARTS, _LATE_EVERY = (7, 15, 22, 31), 50


def telemetry_sliding_stream(spark: S, d: str) -> DataFrame:
    """Sliding windows of two days a day apart, by well and tag, from events delivered in four parts; one in fifty comes with
    the last part, too late for the windows that closed by then."""
    landed, path, marks = (scratch_path(spark, x) for x in ("landed", "sliding", "marks"))
    day, late = F.dayofmonth("ts"), F.col("event_id") % _LATE_EVERY == 0
    points = table(spark, d, "events").select("ts", "event_id", (F.col("user_id") % 5).alias("well"), F.col("event_type").alias("tag"), F.col("ts").cast("timestamp").alias("measured_at"), F.when(F.col("event_id") % 10 != 3, F.col("value")).alias("value"))
    found = None
    for k, last in enumerate(_PARTS):
        own = (day <= last) & (day > ([0, *_PARTS])[k]) & ~late
        points.where(own | late if k == len(_PARTS) - 1 else own).drop("ts").write.mode("append").parquet(landed)
        found = telemetry.sliding(spark.readStream.schema(points.drop("ts").schema).parquet(landed), "2 days", "1 day", "1 day")
        telemetry.append(found, path, marks)
    rows = telemetry.appended(spark, path, found.schema)
    return rows.select("well", "tag", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "points", "gaps", "total")


def index_stream(spark: S, d: str) -> DataFrame:
    """Fragments added to an index once each, from two runs of a stream of which the second brings most documents again."""
    landed, path, marks = (scratch_path(spark, x) for x in ("landed", "index", "marks"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    for part in (docs.where("length(text) < 2000"), docs):
        part.write.mode("append").parquet(landed)
        raw = spark.readStream.schema(docs.schema).parquet(landed)
        found = raw.select("source", "text", search.fragment_id(F.col("source"), F.lit("document"), F.col("text")).alias("fragment_id"))
        telemetry.append_once(found, "fragment_id", path, marks)
    return telemetry.appended(spark, path, found.schema).select("source", "fragment_id", F.length("text").alias("chars"))


def document_scan(spark: S, d: str) -> DataFrame:
    """Conversations as files of four types, by their number; those with a blank or very long turn are broken on purpose of
    their type. Fragments, and refused files with where their fault stands."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct("turn", F.to_json(F.struct("text", "role", "turn")).alias("j"), F.to_csv(F.struct("role", "text"), {"quoteAll": "true", "escape": '"'}).alias("c"), "text")
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"), F.max(F.length("text")).alias("longest"))
    join = lambda field, sep: F.array_join(F.transform("t", lambda t: t[field]), sep)
    bad = F.col("longest") > 700
    body = (
        F.when(F.col("conv_id") % 4 == 0, F.concat(join("text", "\n"), F.when(bad, F.lit("\0")).otherwise("")))
        .when(F.col("conv_id") % 4 == 1, F.concat(F.lit("["), join("j", ","), F.when(bad, ",1e999]").otherwise("]")))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit("\n"), join("j", "\n\n"), F.when(bad, "\nNaN").otherwise("")))
        .otherwise(F.concat(F.lit("role,text\n"), join("c", "\n"), F.when(bad, "\nx").otherwise("")))
    )
    kind = F.element_at(F.array(*map(F.lit, ("text/plain", "application/json", "application/x-ndjson", "text/csv"))), (F.col("conv_id") % 4 + 1).cast("int"))
    held = whole.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), kind.alias("content_type"), body.cast("binary").alias("content"))
    found, refused = documents.fragments(held)
    good = found.select("path", "locator", F.sha2("text", 256).alias("text_sha256"), "metadata", F.lit(None).cast("string").alias("code"))
    return good.unionByName(refused.select("path", "locator", "code"), allowMissingColumns=True)


def activity_file_scan(spark: S, d: str) -> DataFrame:
    """Activity files of fifty parts each, with columns in three orders and two delimiters, by the first rule that each breaks."""
    part = table(spark, d, "part").withColumn("g", F.floor(F.col("p_partkey") / 50))
    volume = F.when((F.col("p_size") == 17) & (F.col("p_retailprice") > 950), "1,5").otherwise(F.col("p_size").cast("string"))
    ident = F.concat(F.lit("a"), F.when((F.col("p_size") == 3) & (F.col("p_partkey") % 50 > 0), F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).cast("string"))
    cells = {"activity_id": ident, "activity_name": F.col("p_name"), "volume": volume, "measurement": F.col("p_brand")}
    orders = [list(cells), ["volume", "activity_id", "measurement", "activity_name"], ["activity_name", "measurement", "activity_id", "volume"]]
    line, header = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, names in enumerate(orders):
        for j, mark in enumerate((";", ",")):
            mine = F.col("g") % 6 == 2 * k + j
            line = F.when(mine, F.concat_ws(mark, *(F.concat(F.lit('"'), cells[n], F.lit('"')) for n in names))).otherwise(line)
            header = F.when(mine, F.lit(mark.join(names))).otherwise(header)
    rows = part.select("g", header.alias("header"), F.struct("p_partkey", line.alias("line")).alias("r"), F.col("p_type"))
    files_ = rows.groupBy("g").agg(F.first("header").alias("header"), F.array_sort(F.collect_list("r")).alias("r"))
    name = F.when(F.col("g") % 7 == 5, F.replace("header", F.lit("volume"), F.lit("amount"))).when(F.col("g") % 11 == 7, F.replace("header", F.lit("measurement"), F.lit("volume"))).otherwise(F.col("header"))
    text = F.concat(name, F.lit("\n"), F.array_join(F.transform("r", lambda r: r["line"]), "\n"), F.when(F.col("g") % 13 == 9, F.lit("\n\"x\"y")).otherwise(""))
    return activities.file_problems(files_.select(F.concat(F.lit("g"), F.col("g").cast("string")).alias("path"), text.alias("text")))


def phrase_candidates(spark: S, d: str) -> DataFrame:
    """Documents that match a phrase of three words from each benchmark item, wholly or by a shared word."""
    words = F.split(F.regexp_replace("text", "\\s+", " "), " ")
    terms = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(words, 2, 3), " ").alias("phrase"))
    found = search.phrase_candidates(table(spark, d, "documents"), terms, "doc_id", "text", "item_id", "phrase")
    return found.select(F.col("record_id").alias("doc_id"), F.col("term_id").alias("item_id"), "phrase_found", F.array_join("words", ",").alias("words"))


def knn_probed(spark: S, d: str) -> DataFrame:
    """Neighbours from the cells nearest to each query, with as many cells as measured recall asks for."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    middle = vectors.centers(rows, 16)
    held = vectors.in_cells(rows, middle)
    probes, _ = vectors.probes_for(asked, held, 5, middle)
    return vectors.nearest_probed(asked, held, 5, middle, probes)


def ontology_validate(spark: S, d: str) -> DataFrame:
    """An ontology for each brand and size of parts: types of parts with a property for each name, relations to the type of the
    part before, and what they cover. Names that two types share repeat an id, and other ends are not declared."""
    part = table(spark, d, "part").withColumn("ontology", F.concat(F.col("p_brand"), F.lit("/"), F.col("p_size").cast("string")))
    none = F.lit(None).cast("string")
    element = lambda df, kind, i, value_type=none, source=none, target=none: df.select("ontology", F.lit(kind).alias("kind"), i.alias("id"), i.alias("label"), value_type.alias("value_type"), source.alias("source_type"), target.alias("target_type"), none.alias("subject_type"))
    types = element(part.select("ontology", "p_type").distinct(), "entity", F.col("p_type"))
    names = element(part.select("ontology", "p_type", "p_name").distinct(), "property", F.col("p_name"), F.lit("string"))
    dear = part.where("p_retailprice > 1000")
    to = F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type"))
    links = element(dear, "relation", F.concat(F.lit("r"), F.col("p_partkey").cast("string")), none, F.col("p_type"), to)
    covers = part.where("p_size > 2").select("ontology", F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("question_id"), F.col("p_name").alias("element_id"))
    docs = part.groupBy("ontology", "p_size").agg(F.count("*").alias("n")).select("ontology", F.concat(F.lit("1."), F.col("n").cast("string"), F.lit(".0")).alias("version"), F.when(F.col("p_size") % 2 == 0, "1.2.0").alias("base_version"), F.when(F.col("p_size") % 2 == 0, "1.2.0").alias("approved_version"))
    return ontology.judge(docs, types.unionByName(names).unionByName(links), covers)


def queries() -> dict:
    found = (ontology_validate, knn_probed, phrase_candidates, document_scan, activity_file_scan, telemetry_sliding_stream, index_stream, manifest_walk, manifest_graph_load, collection_build, collection_guarded_sql, collection_result, graph_upsert_stream, fact_batch_validate)
    return {f.__name__: f for f in found}


QUERIES = queries()

_MANIFEST = """
WITH o AS (
  SELECT *, o_orderstatus = 'F' AND o_totalprice > 400000 AS wrong, o_orderstatus = 'P' AND o_totalprice < 50000 AS nameless FROM orders WHERE o_orderpriority <> '5-LOW'),
r AS (
  SELECT 'Well' AS label, 'osdu:master-data--Well:c' || c_custkey AS key, NULL AS parent, 4 AS properties, NULL AS reason FROM customer
  UNION ALL SELECT 'Wellbore', 'osdu:master-data--' || CASE WHEN wrong THEN 'Well' ELSE 'Wellbore' END || ':o' || o_orderkey, 'osdu:master-data--Well:c' || o_custkey,
                   CASE WHEN nameless THEN 3 ELSE 4 END, CASE WHEN wrong THEN 'wrong id' WHEN nameless THEN 'missing name' END FROM o
  UNION ALL SELECT 'WellLog', 'urn:osdu-demo:WellLog:' || sha256('["osdu:master-data--Wellbore:o' || o_orderkey || '","log ' || o_orderkey || '","osdu:wks:work-product-component--WellLog:1.0.0"]'),
                   'osdu:master-data--Wellbore:o' || o_orderkey, 3, NULL FROM o WHERE o_orderstatus = 'O')"""

_FRAGMENT = "sha256(source || chr(0) || 'document:' || doc_id || chr(0) || coalesce(text, ''))"

SQL = {
    "ontology_validate": """
WITH p AS (SELECT *, p_brand || '/' || p_size AS ontology FROM part),
e AS (SELECT DISTINCT ontology, p_type AS id FROM p), n AS (SELECT DISTINCT ontology, p_type, p_name AS id FROM p), r AS (SELECT * FROM p WHERE p_retailprice > 1000),
ids AS (SELECT ontology, id FROM e UNION ALL SELECT ontology, id FROM n UNION ALL SELECT ontology, 'r' || p_partkey FROM r),
c AS (SELECT ontology, count(*) AS elements FROM ids GROUP BY ontology),
t AS (SELECT ontology, count(*) AS repeated FROM (SELECT ontology, id FROM ids GROUP BY ontology, id HAVING count(*) > 1) GROUP BY ontology),
u AS (SELECT ontology, count(*) AS unknown FROM r WHERE p_partkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e.ontology = r.ontology AND e.id = lower(p_type)) GROUP BY ontology),
o AS (SELECT ontology, p_size, count(*) AS n FROM p GROUP BY ontology, p_size)
SELECT o.ontology, elements, 0 AS malformed, coalesce(repeated, 0) AS repeated_ids, coalesce(unknown, 0) AS unknown_references,
       CASE WHEN p_size <= 2 THEN 'ONTOLOGY_SCHEMA_INVALID' WHEN repeated > 0 THEN 'ONTOLOGY_ID_DUPLICATE' WHEN unknown > 0 THEN 'ONTOLOGY_REFERENCE_INVALID'
            WHEN p_size % 2 = 0 AND n = 2 THEN 'ONTOLOGY_VERSION_CONFLICT' END AS code
FROM o JOIN c USING (ontology) LEFT JOIN t USING (ontology) LEFT JOIN u USING (ontology)""",
    "phrase_candidates": """
WITH d AS (SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\\s+', ' ', 'g')) AS t FROM documents),
b AS (SELECT item_id, replace(lower(array_to_string(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[2:4], ' ')), 'ß', 'ss') AS p FROM benchmark),
bw AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_extract_all(p, '[\\p{L}\\p{N}_]+')) AS w FROM b) WHERE length(w) >= 3),
dw AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}_]+')) AS w FROM d)),
s AS (SELECT doc_id, item_id, string_agg(w, ',' ORDER BY w) AS words FROM dw JOIN bw USING (w) GROUP BY doc_id, item_id),
p AS (SELECT doc_id, item_id, contains(t, p) AS found FROM d, b WHERE p <> '')
SELECT doc_id, item_id, found AS phrase_found, coalesce(words, '') AS words FROM p LEFT JOIN s USING (doc_id, item_id) WHERE found OR words IS NOT NULL""",
    "document_scan": """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (
  SELECT conv_id, conv_id % 4 AS kind, count(*) AS n, max(length(text)) > 700 AS bad, min(CASE WHEN NOT regexp_matches(text, '[^\\s\\p{Z}]') THEN k END) AS blank, bool_and(NOT regexp_matches(text, '[^\\s\\p{Z}]')) AS empty,
         string_agg(text, chr(10) ORDER BY turn) AS whole FROM c GROUP BY conv_id),
p AS (
  SELECT conv_id, 'c' || conv_id AS path, CASE WHEN kind = 0 AND empty AND NOT bad THEN 'DOCUMENT_EMPTY' WHEN kind = 0 AND bad THEN 'DOCUMENT_FORMAT_INVALID'
           WHEN kind = 1 AND bad THEN 'DOCUMENT_FORMAT_INVALID' WHEN kind IN (1, 2) AND blank IS NOT NULL THEN 'DOCUMENT_EMPTY' WHEN kind > 1 AND bad THEN 'DOCUMENT_FORMAT_INVALID' END AS code,
         CASE WHEN kind = 1 AND bad THEN 'document' WHEN kind = 1 THEN 'item:' || blank WHEN kind = 2 AND blank IS NOT NULL THEN 'line:' || 2 * blank WHEN kind = 2 THEN 'line:' || 2 * n + 1 WHEN kind = 3 THEN 'row:' || n + 2 END AS locator,
         kind, whole FROM f)
SELECT path, locator, NULL AS text_sha256, NULL AS metadata, code FROM p WHERE code IS NOT NULL
UNION ALL SELECT path, 'document', sha256(whole), '{}', NULL FROM p WHERE code IS NULL AND kind = 0
UNION ALL SELECT path, CASE kind WHEN 1 THEN 'item:' || k WHEN 2 THEN 'line:' || 2 * k ELSE 'row:' || k + 1 END,
  sha256(CASE WHEN kind = 3 THEN 'role: ' || role || chr(10) || 'text: ' || text ELSE text END),
  CASE WHEN kind = 3 THEN '{"role":' || to_json(role) || ',"text":' || to_json(text) || '}' ELSE '{"role":' || to_json(role) || ',"turn":' || turn || '}' END, NULL
FROM p JOIN c USING (conv_id) WHERE code IS NULL AND kind > 0""",
    "activity_file_scan": """
WITH r AS (
  SELECT p_partkey // 50 AS g, p_partkey % 50 + 1 AS k, p_size = 17 AND p_retailprice > 950 AS bad_number, p_name, p_brand,
         CASE WHEN p_size = 3 AND p_partkey % 50 > 0 THEN p_partkey - 1 ELSE p_partkey END AS id FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY k) > 1 AS twice FROM r),
b AS (SELECT g, count(*) AS n, min(CASE WHEN twice OR bad_number THEN k END) AS pos FROM o GROUP BY g),
w AS (
  SELECT g, n, pos, CASE WHEN g % 13 = 9 THEN 'E_ROW_WIDTH' WHEN g % 7 = 5 THEN 'E_HEADER_UNKNOWN' WHEN g % 11 = 7 THEN 'E_HEADER_DUPLICATE' END AS whole FROM b)
SELECT 'g' || w.g AS path, CASE WHEN w.g % 2 = 0 THEN ';' ELSE ',' END AS delimiter, n + CASE WHEN w.g % 13 = 9 THEN 1 ELSE 0 END AS rows,
  coalesce(whole, CASE WHEN twice THEN 'E_DUPLICATE_ID' WHEN bad_number THEN 'E_VOLUME_INVALID' END) AS problem, CASE WHEN whole IS NULL THEN CAST(pos AS INTEGER) END AS "row"
FROM w LEFT JOIN o ON o.g = w.g AND o.k = w.pos""",
    "telemetry_sliding_stream": """
WITH p AS (SELECT *, event_id % 50 = 0 AS late FROM events),
closed AS (SELECT max(ts) - INTERVAL 1 DAY AS at FROM p WHERE NOT late AND day(ts) <= 22), done AS (SELECT max(ts) - INTERVAL 1 DAY AS at FROM p),
w AS (SELECT *, (date_trunc('day', ts) - to_days(CAST(k AS INTEGER)))::TIMESTAMP AS window_start FROM p, range(2) AS r(k))
SELECT user_id % 5 AS well, event_type AS tag, window_start, count(*) AS points, count(*) FILTER (event_id % 10 = 3 OR value IS NULL) AS gaps,
       CAST(sum(CASE WHEN event_id % 10 <> 3 THEN value::DECIMAL(28,6) END) AS DOUBLE) AS total
FROM w, closed, done WHERE (NOT late OR window_start + INTERVAL 2 DAY > closed.at) AND window_start + INTERVAL 2 DAY <= done.at GROUP BY 1, 2, 3""",
    "index_stream": "SELECT DISTINCT source, sha256(source || chr(0) || 'document' || chr(0) || coalesce(text, '')) AS fragment_id, CAST(length(coalesce(text, '')) AS INTEGER) AS chars FROM documents",
    "manifest_walk": f"{_MANIFEST} SELECT * FROM r",
    "manifest_graph_load": f"""{_MANIFEST}, good AS (SELECT * FROM r WHERE reason IS NULL), bad AS (SELECT count(*) AS n FROM r WHERE reason IS NOT NULL)
SELECT 'records' AS measure, count(*) AS n FROM r UNION ALL SELECT label, count(*) FROM good GROUP BY label
UNION ALL SELECT 'BELONGS_TO_WELL', count(*) FROM good WHERE label = 'Wellbore' UNION ALL SELECT 'BELONGS_TO_WELLBORE', count(*) FROM good WHERE label = 'WellLog'
UNION ALL SELECT 'issues', n FROM bad UNION ALL SELECT 'fatal', 0 UNION ALL SELECT 'passed', 1 UNION ALL SELECT 'published nodes', count(*) FROM good
UNION ALL SELECT 'published edges', count(parent) FROM good UNION ALL SELECT 'second load unchanged', 1""",
    "collection_build": """
SELECT name, rows, true AS unchanged FROM (
  SELECT 'nodes' AS name, (SELECT count(*) FROM documents) + (SELECT count(DISTINCT lang) FROM documents) AS rows
  UNION ALL SELECT 'relations', count(*) FROM documents UNION ALL SELECT 'observations', count(*) FROM labels SEMI JOIN documents USING (doc_id)
  UNION ALL SELECT 'fragments', count(*) FROM documents UNION ALL SELECT 'source_status', count(DISTINCT source) FROM documents)""",
    "collection_guarded_sql": """
SELECT 'lang' AS property, lang AS value, count(*) AS n, count(DISTINCT source) AS sources
FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang""",
    "collection_result": f"""
WITH f AS (SELECT {_FRAGMENT} AS fragment_id, source AS source_id, 'document:' || doc_id AS locator, CAST(octet_length(encode(coalesce(text, ''))) AS INTEGER) AS bytes FROM documents WHERE source >= 'src1'),
r AS (SELECT *, (SELECT count(*) FROM f) > 50 AS truncated FROM f ORDER BY bytes DESC, fragment_id LIMIT 50)
SELECT *, (SELECT count(*) FROM (SELECT DISTINCT source_id, fragment_id FROM r)) AS refs FROM r""",
    "graph_upsert_stream": """
SELECT 'User' AS label, 'user:' || user_id AS key, arg_max(event_type, event_id) AS last, 1 + count(DISTINCT event_type) AS properties, count(DISTINCT event_type) AS edges
FROM events GROUP BY user_id
UNION ALL SELECT DISTINCT 'Kind', 'kind:' || event_type, NULL, 0, 0 FROM events""",
    "fact_batch_validate": f"""
WITH d AS (
  SELECT doc_id, lang, n_chars, source AS batch, coalesce(text, '') AS text, {_FRAGMENT} AS fragment_id, len(string_split(coalesce(text, ''), ' ')) AS w FROM documents),
e AS (
  SELECT *, CASE WHEN w % 23 = 0 THEN batch || 'x' ELSE batch END AS named,
         CASE WHEN w % 17 = 0 THEN left(text, 30) || chr(0) WHEN w % 19 = 0 THEN reverse(left(text, 30)) ELSE left(text, 30) END AS quote,
         (CASE WHEN n_chars < 60 THEN '{{' ELSE '{{"lang":' || CASE WHEN w % 11 = 0 THEN n_chars::VARCHAR ELSE '"' || lang || '"' END || ',' END)
           || CASE WHEN w % 13 = 0 THEN '"letters":' ELSE '"chars":' END || n_chars || CASE WHEN w % 7 = 0 THEN '.5}}' ELSE '}}' END AS properties
  FROM d),
g AS (
  SELECT *, contains(quote, chr(0)) OR regexp_full_match(quote, '[\\s\\p{{Z}}]*') AS blank, named <> batch AS foreign_source, NOT contains(text, quote) AS absent,
         (SELECT count(*) FROM d o WHERE o.batch = e.batch AND 'in:' || o.lang || ':' || o.n_chars = 'in:' || e.lang || ':' || e.n_chars) > 1 AS twice FROM e),
j AS (
  SELECT batch, 'entity' AS kind, 'doc:' || doc_id AS id,
         CASE WHEN blank THEN 'form' WHEN w % 29 = 0 THEN 'undeclared_type' WHEN len(list_filter(json_keys(properties), lambda k: k NOT IN ('lang', 'chars'))) > 0 THEN 'undeclared_property'
              WHEN NOT list_contains(json_keys(properties), 'lang') THEN 'missing_property'
              WHEN json_type(properties, '$.lang') <> 'VARCHAR' OR json_type(properties, '$.chars') NOT IN ('UBIGINT', 'BIGINT') THEN 'wrong_property'
              WHEN foreign_source THEN 'foreign_fragment' WHEN absent THEN 'absent_text' END AS rule, 'FACT_SCHEMA_INVALID' AS wrong FROM g
  UNION ALL
  SELECT batch, 'relation', 'in:' || lang || ':' || n_chars,
         CASE WHEN blank THEN 'form' WHEN twice THEN 'repeated_id' WHEN w % 31 = 0 OR w % 29 = 0 THEN 'wrong_ends' WHEN foreign_source THEN 'foreign_fragment' WHEN absent THEN 'absent_text' END, NULL FROM g
  UNION ALL
  SELECT batch, 'observation', 'size:' || doc_id,
         CASE WHEN blank THEN 'form' WHEN w % 29 = 0 THEN 'wrong_ends' WHEN w % 5 = 0 THEN 'wrong_value' WHEN w % 3 = 0 THEN 'missing_unit' WHEN w % 37 = 0 THEN 'missing_property'
              WHEN foreign_source THEN 'foreign_fragment' WHEN absent THEN 'absent_text' END, 'FACT_MEASUREMENT_INVALID' FROM g)
SELECT batch, kind, id, rule, CASE WHEN rule = 'form' THEN 'FACT_EVIDENCE_INVALID' WHEN rule = 'repeated_id' THEN 'FACT_ID_DUPLICATE' WHEN rule IN ('undeclared_type', 'undeclared_property') THEN 'FACT_TYPE_UNKNOWN'
  WHEN rule = 'wrong_ends' THEN 'FACT_ENDPOINT_INVALID' WHEN rule IN ('wrong_value', 'missing_unit') THEN 'FACT_MEASUREMENT_INVALID' WHEN rule IN ('missing_property', 'wrong_property') THEN wrong
  WHEN rule = 'foreign_fragment' THEN 'FACT_SOURCE_INVALID' WHEN rule = 'absent_text' THEN 'FACT_EVIDENCE_INVALID' END AS code FROM j""",
}
