"""Queries over vectors, documents, tables, publications, transcripts and telemetry: documents are fragments and
publications, pages web sources, embeddings a catalogue, events telemetry, labels decisions, benchmark quotes, part
activities, conversations transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators import news, search, tabular, text, vectors
from quarrylake.sources import files
from quarrylake.storage import scratch_path, stash, table
from quarrylake.streaming import telemetry

S = SparkSession


def vector_normalize(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x * 3))
    unit = e.withColumn("u", vectors.normalize(F.col("v")))
    return unit.select("vec_id", F.round(vectors.norm(F.col("v")), 4).alias("norm"), F.round(vectors.norm(F.col("u")), 4).alias("unit"), vectors.sound(F.col("v"), 64).alias("sound"))


def _queries(spark: S, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


def knn_flat(spark: S, d: str) -> DataFrame:
    catalogue = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.nearest(_queries(spark, d).drop("label"), catalogue, 5)


def knn_level_filter(spark: S, d: str) -> DataFrame:
    catalogue = table(spark, d, "embeddings").where(F.col("label").isin(1, 3)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.nearest(_queries(spark, d).drop("label"), catalogue, 3)


def knn_two_stage(spark: S, d: str) -> DataFrame:
    """The best two categories of each query by mean vector, then the best names within them."""
    e = table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    cats = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("v"))
    cats = cats.select(F.col("label").alias("id"), vectors.normalize(F.col("v")).alias("vector"))
    asked = _queries(spark, d).drop("label")
    best = vectors.nearest(asked, cats, 2).select("query_id", F.col("id").alias("label"))
    names = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return vectors.nearest(asked.join(best, "query_id"), names, 5, within="label")


def category_codes(spark: S, d: str) -> DataFrame:
    return tabular.codes(table(spark, d, "part"), "p_type", "code")


def fragments_lines(spark: S, d: str) -> DataFrame:
    lines = search.lines(table(spark, d, "documents"), "doc_id", "text")
    return lines.select("source", "locator", search.fragment_id(F.col("source"), F.col("locator"), F.col("text")).alias("fragment_id"))


def inverted_index_stats(spark: S, d: str) -> DataFrame:
    postings, _ = search.index(table(spark, d, "documents"), "doc_id", "text")
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_search(spark: S, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), "the tion of scum the", "doc_id", "text", 20)


def bm25_filtered(spark: S, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents").where("source in ('src1', 'src2')"), "le la menteux", "doc_id", "text", 10)


def search_excerpt(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", search.excerpt(F.col("text"), ["idiot", "scum"], 60).alias("excerpt"))


def fragment_read(spark: S, d: str) -> DataFrame:
    ids = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (7, 3, 11, -5)))).alias("pos", "doc_id"))
    return F.broadcast(ids).join(table(spark, d, "documents"), "doc_id", "left").select("pos", "doc_id", F.substring("text", 1, 40).alias("text"), (F.length("text") > 40).alias("truncated"), F.col("text").isNull().alias("unknown"))


def evidence_check(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fragment_id"), "source", "text")
    quotes = table(spark, d, "documents").select(F.col("doc_id").alias("quote_id"), (F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 1 << 40).otherwise(0)).alias("fragment_id"), F.when(F.col("doc_id") % 5 == 0, "src0").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 3 == 0, "no such words").otherwise(F.substring("text", 3, 20)).alias("quote"))
    return search.evidence(quotes, docs)


def fact_type_check(spark: S, d: str) -> DataFrame:
    kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, ("entity", "relation")))).alias("kind"))
    facts = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "relation").when(F.col("quality") == 1, "entity").otherwise("unheard").alias("kind"))
    return facts.join(F.broadcast(kinds.withColumn("known", F.lit(True))), "kind", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count("known").alias("valid"))


def fact_endpoint_check(spark: S, d: str) -> DataFrame:
    facts = table(spark, d, "labels").select("doc_id", (F.col("doc_id") + 1).alias("end_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("stated"))
    batch = table(spark, d, "labels").select(F.col("doc_id").alias("end_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("batch_type"))
    judged = facts.join(batch, "end_id", "left")
    return judged.select("doc_id", F.coalesce("batch_type", "stated").alias("end_type"), F.coalesce(F.col("batch_type") != F.col("stated"), F.lit(False)).alias("disagrees"))


def _entities(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    long = docs.select((F.col("doc_id") % 50).alias("node_id"), F.lit("doc").alias("type_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("batch_sha"), F.explode(F.array(F.struct(F.lit("lang").alias("name"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("name"), F.col("source").alias("value")))).alias("p"))
    return long.select("node_id", "type_id", "batch_sha", "p.name", "p.value")


def entity_merge_conflicts(spark: S, d: str) -> DataFrame:
    merged, conflicts = news.merge_identical(_entities(spark, d))
    return merged.join(conflicts, ["node_id", "type_id", "name"], "left").select("node_id", "name", "value", F.coalesce("values", F.lit(1)).alias("values"))


def input_fingerprint(spark: S, d: str) -> DataFrame:
    """A checksum of each source's input that does not depend on row order: rows are summed up in 64 batches, and the sorted
    batch checksums are hashed, so no source's texts meet in one task."""
    part = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    batch = table(spark, d, "documents").groupBy("source", (F.col("doc_id") % 64).alias("batch")).agg(F.count("*").alias("n"), F.sum(part).alias("s"))
    hashes = batch.select("source", F.sha2(F.concat_ws(":", "batch", "n", "s"), 256).alias("h")).groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("h")), ",").alias("h"))
    return hashes.select("source", F.sha2("h", 256).alias("fingerprint"))


def collection_sql(spark: S, d: str) -> DataFrame:
    table(spark, d, "documents").createOrReplaceTempView("ql_documents")
    table(spark, d, "labels").createOrReplaceTempView("ql_labels")
    return spark.sql("SELECT d.source, count(*) AS n, sum(l.toxic) AS toxic FROM ql_documents d JOIN ql_labels l ON d.doc_id = l.doc_id WHERE d.lang = :lang GROUP BY d.source", args={"lang": "en"})


def calculator_inputs(spark: S, d: str) -> DataFrame:
    obs = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") == 1, "NULL").when(F.col("l_linenumber") == 2, "x").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("raw"), F.when(F.col("l_linenumber") == 3, "bbl").otherwise("m3").alias("unit"))
    why = F.when(F.col("raw") == "NULL", "missing").when(~F.col("raw").rlike(tabular.NUMERIC), "non_numeric").when(F.col("unit") != "m3", "wrong_unit").otherwise("used")
    return obs.withColumn("outcome", why).groupBy("l_returnflag", "outcome").agg(F.count("*").alias("n"), F.sum(F.when(F.col("outcome") == "used", F.col("raw").try_cast("double"))).alias("total"))


def formula_eval(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice") / (F.col("p_size") % 5)), 6).alias("ratio"), F.when(F.col("p_size") % 5 == 0, "division_by_zero").alias("problem"))


def csv_violations(spark: S, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.col("p_name"))
    volume = F.when(F.col("p_partkey") % 7 == 0, "1,5").when(F.col("p_partkey") % 13 == 0, "nan").otherwise(F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("A"), F.floor(F.col("p_partkey") / 2), F.when(F.col("p_partkey") % 4 == 1, " ").otherwise("")).alias("activity_id"), name.alias("name"), volume.alias("volume"))
    rows = tabular.mark_later(rows, "activity_id", "p_partkey", "later")
    code = tabular.first_failure([("blank_required", F.trim("name") == ""), ("duplicate_id", F.col("later")), ("bad_number", ~F.col("volume").rlike(tabular.NUMERIC))])
    return rows.select("p_partkey", code.alias("code"))


def csv_formula_guard(spark: S, d: str) -> DataFrame:
    heads = F.element_at(F.array(*map(F.lit, ("=", "-5", " @", "x", "+1e3", "|cmd"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    cell = F.when(F.col("p_partkey") % 6 == 3, F.col("p_name")).otherwise(F.concat(heads, F.when(F.col("p_partkey") % 6 == 0, F.col("p_brand")).otherwise("")))
    return table(spark, d, "part").select("p_partkey", tabular.guard_cell(cell).alias("cell"))


def csv_structure_tree(spark: S, d: str) -> DataFrame:
    parts = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("works"), F.min("p_partkey").alias("first"))
    return parts.groupBy("p_brand").agg(F.count("*").alias("children"), F.sum("works").alias("works"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_type", "works"))), lambda x: F.concat(x["p_type"], F.lit("="), x["works"])), ";").alias("tree"))


def csv_structure_levels(spark: S, d: str) -> DataFrame:
    levels = F.array((F.col("p_size") % 2 + 1).cast("int"), (F.col("p_size") % 3 + 1).cast("int"), F.lit(4))
    return table(spark, d, "part").select("p_partkey", tabular.levels_valid(levels).alias("valid"))


def csv_unknown_dictionary(spark: S, d: str) -> DataFrame:
    known = table(spark, d, "part").where("p_size > 10").select("p_brand", "p_type")
    return tabular.unknown_values(table(spark, d, "part"), ["p_brand", "p_type"], known)


def csv_edges_check(spark: S, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("FS", "SS", "FF", "SF", "XX"))), (F.col("p_size") % 5 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", kind.alias("kind"), (F.col("p_partkey") + F.when(F.col("p_size") == 1, 1 << 40).otherwise(1)).alias("predecessor"))
    known = table(spark, d, "part").select(F.col("p_partkey").alias("predecessor")).withColumn("there", F.lit(True))
    code = tabular.first_failure([("bad_type", ~F.col("kind").isin("FS", "SS", "FF", "SF")), ("unknown_predecessor", F.col("there").isNull())])
    return rows.join(known, "predecessor", "left").select("p_partkey", code.alias("code"))


def _publications(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("source"), F.concat(F.lit("HTTPS://News.Example.org/"), F.col("doc_id") % 700, F.lit("#a")).alias("url"), F.when(F.col("doc_id") % 13 != 0, F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd")).alias("published"))


def candidate_audit(spark: S, d: str) -> DataFrame:
    return news.audit(_publications(spark, d), "2024-01-10", "2024-02-10", F.contains(F.lower("text"), F.lit("scum"))).select("doc_id", "status")


def duplicate_links(spark: S, d: str) -> DataFrame:
    p = _publications(spark, d)
    return news.duplicate_links(p, "doc_id", {"url": news.canonical_url(F.col("url"))})


def duplicate_groups(spark: S, d: str) -> DataFrame:
    p = _publications(spark, d)
    return news.duplicate_groups(p, "doc_id", {"content": F.lower(F.trim("text"))})


def repost_consistency(spark: S, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("n"), F.count_distinct("toxic").alias("decisions")).where("decisions > 1")


def news_statistics(spark: S, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id")
    by = joined.select("source", F.explode(F.array("lang", F.concat(F.lit("toxic"), F.col("toxic")))).alias("category"), "doc_id")
    return by.groupBy("category").agg(F.count("*").alias("publications"), F.count_distinct("source").alias("publishers"))


def decision_completeness(spark: S, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id")
    decided = labels.where("doc_id % 17 <> 0").unionByName(labels.where("doc_id % 19 = 0")).unionByName(labels.where("doc_id % 23 = 0").select((F.col("doc_id") + (1 << 40)).alias("doc_id")))
    return news.completeness(labels, decided, "doc_id")


def event_cover(spark: S, d: str) -> DataFrame:
    included = table(spark, d, "labels").where("quality = 1").select("doc_id")
    events = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return included.join(events, "doc_id", "left_anti").select("doc_id", F.lit("no_event").alias("problem")).unionByName(events.join(included, "doc_id", "left_anti").select("doc_id", F.lit("not_included").alias("problem")))


def domain_period_filter(spark: S, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", news.canonical_url(F.col("url")).alias("url"), news.host(F.col("url")).alias("host"))
    return pages.select("page_id", "url", "host", news.domain_matches(F.col("host"), ["example.org", "m.thther.example.com"]).alias("allowed"))


def url_outcomes(spark: S, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("u"), F.col("page_id") % 100).alias("url"))
    asked = spark.range(0, 120).select(F.concat(F.lit("u"), "id").alias("url"))
    rows = asked.join(pages.where("page_id % 10 <> 3").groupBy("url").agg(F.count("*").alias("n")), "url", "left")
    return rows.select("url", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("page").alias("outcome"))


def corpus_dedup(spark: S, d: str) -> DataFrame:
    held = table(spark, d, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("h"))
    first = stash(held.groupBy("h").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1"), "first-texts")
    return held.join(first, "h").where("doc_id <> kept").select("doc_id", "kept")


def chunk_split(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"), 6000)).alias("n", "chunk")).select("doc_id", "n", F.length("chunk").alias("length"), F.sha2("chunk", 256).alias("sha"))


def message_quality(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("text", F.when(F.col("turn") == 2, F.concat(F.lit("REVISE "), "text")).when(F.col("turn") == 3, F.concat(F.lit('{"a": 1} '), "text")).otherwise(F.col("text")))
    return c.groupBy("role", text.message_problem(F.col("text")).alias("problem")).agg(F.count("*").alias("n"))


def markdown_clean(spark: S, d: str) -> DataFrame:
    raw = F.concat(F.lit("\n<!-- image -->\n\n\n\n"), F.col("text"), F.lit("\n\n\n\nend \n"))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.clean_markdown(raw), 256).alias("sha"))


def text_cleanup(spark: S, d: str) -> DataFrame:
    raw = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.unify_lines(raw), 256).alias("sha"), F.octet_length(text.unify_lines(raw)).alias("bytes"))


def answer_text_normalize(spark: S, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.normalize_answer(F.concat(F.lit("[A] – "), F.col("text"))), 256).alias("sha"))


def split_leakage(spark: S, d: str) -> DataFrame:
    hashed = lambda name: table(spark, d, name).select(F.sha2("text", 256).alias("h"))
    return hashed("documents").join(hashed("benchmark").distinct(), "h", "left_semi").agg(F.count("*").alias("leaked"))


def _points(spark: S, d: str) -> DataFrame:
    value = F.when(F.col("event_id") % 10 != 0, F.col("value"))
    return table(spark, d, "events").select(F.col("event_id").alias("point_id"), F.col("event_type").alias("tag"), F.col("ts").cast("timestamp").alias("measured_at"), value.alias("value"), F.when(F.col("event_id") % 4 != 0, "bar").alias("unit"))


def telemetry_envelope(spark: S, d: str) -> DataFrame:
    return telemetry.envelope(_points(spark, d)).groupBy("tag", "status").agg(F.count("*").alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("null_values"))


def telemetry_latest(spark: S, d: str) -> DataFrame:
    return telemetry.latest(_points(spark, d)).select("tag", "value", "point_id")


def _stream(spark: S, d: str) -> DataFrame:
    raw = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    value = F.when(F.col("event_id") % 10 != 0, F.col("value"))
    return raw.select(F.col("event_id").alias("point_id"), F.col("event_type").alias("tag"), F.col("ts").cast("timestamp").alias("measured_at"), value.alias("value"))


def telemetry_windows_stream(spark: S, d: str) -> DataFrame:
    found = telemetry.windows(telemetry.deduplicated(_stream(spark, d), "40 days"))
    return telemetry.run_available(found, "complete", "telemetry-windows").select("tag", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "points", "gaps", "total")


def telemetry_stream_rows(spark: S, d: str) -> DataFrame:
    found = telemetry.run_available(telemetry.deduplicated(_stream(spark, d), "40 days"), "append", "telemetry-rows")
    return found.groupBy("tag").agg(F.count("*").alias("n"), F.count("value").alias("valued"))


def verified_scan(spark: S, d: str) -> DataFrame:
    path = scratch_path(spark, "verified")
    table(spark, d, "nation").select(F.concat_ws(";", "n_nationkey", "n_name", "n_regionkey").alias("value"), "n_regionkey").repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    found = files.scan(spark, path, "part-*")
    listed = found.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "bytes", F.when(F.contains("path", F.lit("=3/")), "0").otherwise(F.col("sha256")).alias("sha256"))
    return files.verify(found, listed).groupBy("problem").agg(F.count("*").alias("n"))


#: Rows of each delimited file that csv_file_scan writes and reads.
CSV_ROWS = 5000


def csv_file_scan(spark: S, d: str) -> DataFrame:
    path = scratch_path(spark, "delimited")
    table(spark, d, "part").select("p_partkey", "p_name", "p_size").write.option("maxRecordsPerFile", CSV_ROWS).option("header", True).option("sep", ";").csv(path)
    rows = files.delimited(files.scan(spark, path, "part-*"))
    return rows.select(F.get("cells", F.lit(0)).cast("long").alias("p_partkey"), F.get("cells", F.lit(1)).alias("p_name"), "encoding", "delimiter")


QUERIES = {f.__name__: f for f in (vector_normalize, knn_flat, knn_level_filter, knn_two_stage, category_codes, fragments_lines, inverted_index_stats, bm25_search, bm25_filtered, search_excerpt, fragment_read, evidence_check, fact_type_check, fact_endpoint_check, entity_merge_conflicts, input_fingerprint, collection_sql, calculator_inputs, formula_eval, csv_violations, csv_formula_guard, csv_structure_tree, csv_structure_levels, csv_unknown_dictionary, csv_edges_check, candidate_audit, duplicate_links, duplicate_groups, repost_consistency, news_statistics, decision_completeness, event_cover, domain_period_filter, url_outcomes, corpus_dedup, chunk_split, message_quality, markdown_clean, text_cleanup, answer_text_normalize, split_leakage, telemetry_envelope, telemetry_latest, telemetry_windows_stream, telemetry_stream_rows, verified_scan, csv_file_scan)}

_KNN = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
m AS (SELECT query_id, vec_id AS id, round(1 - list_inner_product(embedding::DOUBLE[], v), 5) + 0.0 AS distance FROM embeddings, q WHERE FILTER),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM m)
SELECT query_id, id, distance, rank FROM r WHERE rank <= LIMIT_K"""


def _bm25(words: str, where: str, limit: int) -> str:
    return f"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents WHERE {where}),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
w AS (SELECT term, count(*) AS times FROM (SELECT unnest(string_split('{words}', ' ')) AS term) GROUP BY term),
p AS (SELECT id, len(t) AS dl, term FROM (SELECT id, t, unnest(t) AS term FROM d)),
tf AS (SELECT p.id, p.dl, p.term, count(*) AS tf FROM p JOIN w USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT id, round(-sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
FROM tf JOIN df USING (term) JOIN w USING (term), s GROUP BY id ORDER BY score, id LIMIT {limit}"""


_P = "pub AS (SELECT doc_id, text, CASE WHEN doc_id % 9 <> 0 THEN source END AS source, CASE WHEN doc_id % 13 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) END AS published FROM documents)"
_PT = "pt AS (SELECT event_id AS point_id, event_type AS tag, ts, CASE WHEN event_id % 10 <> 0 THEN value END AS value, CASE WHEN event_id % 4 <> 0 THEN 'bar' END AS unit FROM events)"

SQL = {
    "vector_normalize": "SELECT vec_id, round(3 * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, 1.0::DOUBLE AS unit, true AS sound FROM embeddings",
    "knn_flat": "WITH" + _KNN.replace("FILTER", "true").replace("LIMIT_K", "5"),
    "knn_level_filter": "WITH" + _KNN.replace("FILTER", "label IN (1, 3)").replace("LIMIT_K", "3"),
    "knn_two_stage": """
WITH e AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM e GROUP BY label),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
b AS (SELECT query_id, q.v, label, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_inner_product(q.v, c.v) / n, 5), label) AS k FROM q, c),
m AS (SELECT query_id, vec_id AS id, round(1 - list_inner_product(embedding::DOUBLE[], v), 5) + 0.0 AS distance FROM b JOIN embeddings USING (label) WHERE k <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM m)
SELECT * FROM r WHERE rank <= 5""",
    "category_codes": "SELECT p_type, row_number() OVER (ORDER BY p_type) AS code FROM (SELECT DISTINCT p_type FROM part)",
    "fragments_lines": """
WITH l AS (SELECT doc_id AS source, i, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))
SELECT source, 'line:' || i AS locator, sha256(source || chr(0) || 'line:' || i || chr(0) || text) AS fragment_id FROM l WHERE trim(text) <> ''""",
    "inverted_index_stats": """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""",
    "bm25_search": _bm25("the tion of scum the", "true", 20),
    "bm25_filtered": _bm25("le la menteux", "source IN ('src1', 'src2')", 10),
    "search_excerpt": """
WITH a AS (SELECT doc_id, text, least(nullif(instr(lower(text), 'idiot'), 0), nullif(instr(lower(text), 'scum'), 0)) AS p FROM documents),
s AS (SELECT *, greatest(coalesce(p, 1) - 30, 1) AS start FROM a)
SELECT doc_id, CASE WHEN start > 1 THEN '...' ELSE '' END || substring(text, start, 60) || CASE WHEN start + 59 < length(text) THEN '...' ELSE '' END AS excerpt FROM s""",
    "fragment_read": """
WITH ids AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 11), (3, -5)) v(pos, doc_id))
SELECT pos, ids.doc_id, left(text, 40) AS text, length(text) > 40 AS truncated, text IS NULL AS unknown FROM ids LEFT JOIN documents d ON d.doc_id = ids.doc_id""",
    "evidence_check": """
WITH q AS (SELECT doc_id AS quote_id, doc_id + CASE WHEN doc_id % 7 = 0 THEN 1099511627776 ELSE 0 END AS fragment_id,
  CASE WHEN doc_id % 5 = 0 THEN 'src0' ELSE source END AS source, CASE WHEN doc_id % 3 = 0 THEN 'no such words' ELSE substring(text, 3, 20) END AS quote FROM documents)
SELECT quote_id, fragment_id, CASE WHEN d.doc_id IS NULL THEN 'unknown_fragment' WHEN q.source IS DISTINCT FROM d.source THEN 'foreign_source'
  WHEN NOT contains(d.text, quote) THEN 'absent_quote' END AS problem FROM q LEFT JOIN documents d ON d.doc_id = fragment_id""",
    "fact_type_check": """
WITH f AS (SELECT CASE WHEN toxic = 1 THEN 'relation' WHEN quality = 1 THEN 'entity' ELSE 'unheard' END AS kind FROM labels)
SELECT kind, count(*) AS n, CASE WHEN kind = 'unheard' THEN 0 ELSE count(*) END AS valid FROM f GROUP BY kind""",
    "fact_endpoint_check": """
WITH f AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t FROM labels)
SELECT a.doc_id, coalesce(b.t, a.t) AS end_type, coalesce(b.t <> a.t, false) AS disagrees FROM f a LEFT JOIN f b ON b.doc_id = a.doc_id + 1""",
    "entity_merge_conflicts": """
WITH e AS (SELECT doc_id % 50 AS node_id, sha256(doc_id::VARCHAR) AS b, 'lang' AS name, lang AS value FROM documents UNION ALL SELECT doc_id % 50, sha256(doc_id::VARCHAR), 'source', source FROM documents)
SELECT node_id, name, min_by(value, b) AS value, count(DISTINCT value) AS values FROM e GROUP BY ALL""",
    "input_fingerprint": """
WITH b AS (SELECT source, doc_id % 64 AS batch, count(*) AS n, sum(('0x' || left(sha256(coalesce(text, '')), 15))::BIGINT) AS s FROM documents GROUP BY 1, 2)
SELECT source, sha256(string_agg(h, ',' ORDER BY h)) AS fingerprint FROM (SELECT source, sha256(batch || ':' || n || ':' || s) AS h FROM b) GROUP BY source""",
    "collection_sql": "SELECT source, count(*) AS n, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' GROUP BY source",
    "calculator_inputs": """
SELECT l_returnflag, CASE l_linenumber WHEN 1 THEN 'missing' WHEN 2 THEN 'non_numeric' WHEN 3 THEN 'wrong_unit' ELSE 'used' END AS outcome, count(*) AS n,
       sum(CASE WHEN l_linenumber > 3 THEN floor(l_quantity) END)::DOUBLE AS total FROM lineitem GROUP BY 1, 2""",
    "formula_eval": "SELECT p_partkey, round(CASE WHEN p_size % 5 <> 0 THEN p_retailprice / (p_size % 5) END, 6) AS ratio, CASE WHEN p_size % 5 = 0 THEN 'division_by_zero' END AS problem FROM part",
    "csv_violations": """
WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey) > 1 AS later FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'blank_required' WHEN later THEN 'duplicate_id' WHEN p_partkey % 7 = 0 OR p_partkey % 13 = 0 THEN 'bad_number' END AS code FROM r""",
    "csv_formula_guard": """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '''=' || p_brand WHEN 1 THEN '-5' WHEN 2 THEN ''' @' WHEN 3 THEN p_name WHEN 4 THEN '+1e3' ELSE '''|cmd' END AS cell FROM part""",
    "csv_structure_tree": """
WITH t AS (SELECT p_brand, p_type, count(*) AS works FROM part GROUP BY ALL)
SELECT p_brand, count(*) AS children, sum(works)::BIGINT AS works, string_agg(p_type || '=' || works, ';' ORDER BY p_type) AS tree FROM t GROUP BY p_brand""",
    "csv_structure_levels": "SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 + 1 > 1 AND p_size % 3 + 1 < 4 AS valid FROM part",
    "csv_unknown_dictionary": "SELECT DISTINCT p_brand, p_type FROM part EXCEPT SELECT p_brand, p_type FROM part WHERE p_size > 10",
    "csv_edges_check": """
SELECT p.p_partkey, CASE WHEN p.p_size % 5 = 4 THEN 'bad_type' WHEN k.p_partkey IS NULL THEN 'unknown_predecessor' END AS code
FROM part p LEFT JOIN part k ON k.p_partkey = p.p_partkey + CASE WHEN p.p_size = 1 THEN 1099511627776 ELSE 1 END""",
    "candidate_audit": f"""
WITH {_P} SELECT doc_id, CASE WHEN NOT coalesce(published BETWEEN DATE '2024-01-10' AND DATE '2024-02-10', false) THEN 'outside_period'
  WHEN coalesce(trim(text), '') = '' OR coalesce(trim(source), '') = '' THEN 'insufficient_evidence' WHEN contains(lower(text), 'scum') THEN 'candidate' ELSE 'no_match' END AS status FROM pub""",
    "duplicate_links": "SELECT 'url' AS basis, u, v FROM (SELECT doc_id AS v, lag(doc_id) OVER (PARTITION BY doc_id % 700 ORDER BY doc_id) AS u FROM documents) WHERE u IS NOT NULL",
    "duplicate_groups": """
SELECT doc_id AS node, m AS component FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(trim(text))) AS m, count(*) OVER (PARTITION BY lower(trim(text))) AS n FROM documents WHERE trim(text) <> '') WHERE n > 1""",
    "repost_consistency": "SELECT sha256(text) AS content, count(*) AS n, count(DISTINCT toxic) AS decisions FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT toxic) > 1",
    "news_statistics": """
WITH j AS (SELECT source, lang, toxic FROM documents JOIN labels USING (doc_id) WHERE quality = 1), b AS (SELECT source, lang AS category FROM j UNION ALL SELECT source, 'toxic' || toxic FROM j)
SELECT category, count(*) AS publications, count(DISTINCT source) AS publishers FROM b GROUP BY category""",
    "decision_completeness": """
SELECT doc_id, 'missing' AS problem FROM labels WHERE doc_id % 17 = 0 AND doc_id % 19 <> 0
UNION ALL SELECT doc_id, 'repeated' FROM labels WHERE doc_id % 17 <> 0 AND doc_id % 19 = 0
UNION ALL SELECT doc_id + 1099511627776, 'unexpected' FROM labels WHERE doc_id % 23 = 0""",
    "event_cover": "SELECT doc_id, 'no_event' AS problem FROM labels WHERE quality = 1 AND toxic <> 1 UNION ALL SELECT doc_id, 'not_included' FROM labels WHERE toxic = 1 AND quality <> 1",
    "domain_period_filter": """
WITH p AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages),
h AS (SELECT *, regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS head FROM p),
x AS (SELECT page_id, lower(head) || substring(bare, length(head) + 1) AS url, lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM h)
SELECT *, host = 'example.org' OR host LIKE '%.example.org' OR host = 'm.thther.example.com' OR host LIKE '%.m.thther.example.com' AS allowed FROM x""",
    "url_outcomes": """
WITH n AS (SELECT page_id % 100 AS k, count(*) AS n FROM pages WHERE page_id % 10 <> 3 GROUP BY 1)
SELECT 'u' || i AS url, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'page' END AS outcome FROM range(0, 120) r(i) LEFT JOIN n ON k = i""",
    "corpus_dedup": "SELECT doc_id, kept FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(text)) AS kept FROM documents) WHERE doc_id <> kept",
    "chunk_split": """
SELECT doc_id, CAST(i AS INTEGER) AS n, length(substring(text, i * 6000 + 1, 6000)) AS length, sha256(substring(text, i * 6000 + 1, 6000)) AS sha
FROM documents, unnest(range(0, (length(text) + 5999) // 6000)) AS u(i)""",
    "message_quality": """
WITH c AS (SELECT role, trim(CASE turn WHEN 2 THEN 'REVISE ' || text WHEN 3 THEN '{"a": 1} ' || text ELSE text END) AS t FROM conversations),
p AS (SELECT role, CASE WHEN coalesce(t, '') = '' THEN 'empty' WHEN regexp_matches(t, '(?m)^REVISE\\b') THEN 'revise' WHEN regexp_matches(t, '^\\{\\s*"') THEN 'dump'
  WHEN list_max(list_transform(regexp_extract_all(t, '\\b[0-9]{4,}\\b'), lambda x: len(list_filter(regexp_extract_all(t, '\\b[0-9]{4,}\\b'), lambda y: y = x)))) >= 3 THEN 'repeated_count' END AS problem FROM c)
SELECT role, problem, count(*) AS n FROM p GROUP BY ALL""",
    "markdown_clean": """
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(chr(10) || '<!-- image -->' || repeat(chr(10), 4) || text || repeat(chr(10), 4) || 'end ' || chr(10), '<!-- *image *-->', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS sha FROM documents""",
    "text_cleanup": "SELECT doc_id, sha256(text) AS sha, octet_length(encode(text)) AS bytes FROM documents",
    "answer_text_normalize": "SELECT conv_id, turn, sha256(trim(regexp_replace(translate(lower('[A] – ' || text), '–—− «»[](){}', '---  \"\"'), '\\s+', ' ', 'g'))) AS sha FROM conversations",
    "split_leakage": "SELECT count(*) AS leaked FROM documents WHERE text IN (SELECT text FROM benchmark)",
    "telemetry_envelope": f"WITH {_PT} SELECT tag, CASE WHEN unit IS NULL OR ts IS NULL THEN 'incomplete' ELSE 'ok' END AS status, count(*) AS n, count(*) - count(value) AS null_values FROM pt GROUP BY 1, 2",
    "telemetry_latest": f"WITH {_PT} SELECT tag, value, point_id FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, point_id DESC) AS k FROM pt) WHERE k = 1",
    "telemetry_windows_stream": f"WITH {_PT} SELECT tag, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS points, count(*) - count(value) AS gaps, sum(value::DECIMAL(28,6))::DOUBLE AS total FROM pt GROUP BY 1, 2",
    "telemetry_stream_rows": f"WITH {_PT} SELECT tag, count(*) AS n, count(value) AS valued FROM pt GROUP BY tag",
    "csv_file_scan": "SELECT p_partkey, p_name, 'utf-8' AS encoding, ';' AS delimiter FROM part",
}
