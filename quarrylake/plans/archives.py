"""Queries over publication archives: documents are saved sources, labels the decisions on them, languages with the toxic
label the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.operators import archives
from quarrylake.storage import table

S = SparkSession


def _archive(spark: S, d: str) -> dict[str, DataFrame]:
    """The parts of a result; some decisions, events and quotes are made wrong by rules over ids."""
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang").where("text is not null")
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd")
    url = F.concat(F.lit("https://"), F.when(F.col("doc_id") % 23 == 0, "Mirror").otherwise("www"), F.lit(".Example.org/"), "doc_id")
    sources = docs.select(F.col("doc_id").alias("source_id"), "text", F.substring("text", 1, 40).alias("title"), url.alias("url"), day.alias("published"))
    decisions = labels.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("source_id"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"))
    both = labels.join(docs, "doc_id")
    members = both.where("(quality = 1 and doc_id % 31 <> 0) or doc_id % 29 = 0").select(F.concat("lang", "toxic").alias("event_id"), F.col("doc_id").alias("source_id"))
    members = members.unionByName(members.where("event_id = 'en0'").withColumn("event_id", F.lit("en0 again")))
    events = members.select("event_id").distinct().select("event_id", F.substring("event_id", 1, 2).alias("content"))
    quote = F.when(F.col("doc_id") % 11 == 0, F.reverse(F.substring("text", 11, 80))).otherwise(F.concat(F.lit(" "), F.regexp_replace(F.substring("text", 11, 80), " ", "\n ")))
    shown = both.where("quality = 1 and doc_id % 13 <> 0").select(F.lit("publication").alias("kind"), F.lit(None).cast("string").alias("owner"), F.col("doc_id").alias("source_id"), quote.alias("quote"))
    cited = members.where("source_id % 37 <> 0").join(docs, docs["doc_id"] == members["source_id"]).select(F.lit("event").alias("kind"), F.col("event_id").alias("owner"), "source_id", quote.alias("quote"))
    citations = shown.unionByName(cited).unionByName(cited.where("source_id % 41 = 0"))
    return {"sources": sources, "decisions": decisions, "events": events, "members": members, "citations": citations}


def news_result_check(spark: S, d: str) -> DataFrame:
    return archives.result_problems(**_archive(spark, d), start="2024-01-05", end="2024-02-20", include=["example.org"], exclude=["mirror.example.org"])


def _links(spark: S, d: str) -> DataFrame:
    keys = {"text": F.lower("text"), "head": F.substring("text", 1, 60), "end": F.reverse(F.substring(F.reverse("text"), 1, 60))}
    return archives.grouped_links(table(spark, d, "documents"), "doc_id", keys)


def archive_groups(spark: S, d: str) -> DataFrame:
    """Records that equal texts, beginnings or endings join, with the keys that link each."""
    return archives.group_rows(_links(spark, d))


def quote_locations(spark: S, d: str) -> DataFrame:
    """Documents in which whole benchmark items stand."""
    found = archives.locate_quotes(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")
    return found.select(F.col("quote_id").alias("item_id"), F.col("id").alias("doc_id"))


QUERIES = {f.__name__: f for f in (news_result_check, archive_groups, quote_locations)}

SQL = {
    "news_result_check": """
WITH s AS (SELECT *, doc_id % 60 AS day FROM documents WHERE text IS NOT NULL), l AS (SELECT * FROM labels),
dec AS (SELECT doc_id, quality = 1 AS inc FROM l WHERE doc_id % 17 <> 0), inc AS (SELECT doc_id FROM dec WHERE inc),
b AS (SELECT l.doc_id, quality, toxic, lang, text FROM l JOIN s USING (doc_id)),
m0 AS (SELECT lang || toxic AS ev, doc_id FROM b WHERE (quality = 1 AND doc_id % 31 <> 0) OR doc_id % 29 = 0),
m AS (SELECT * FROM m0 UNION ALL SELECT 'en0 again', doc_id FROM m0 WHERE ev = 'en0'),
q AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN reverse(substring(text, 11, 80)) ELSE substring(text, 11, 80) END AS raw, text FROM s),
f AS (SELECT doc_id, trim(regexp_replace(raw, '[\\x20\\t-\\r]+', ' ', 'g')) AS quote, trim(regexp_replace(text, '[\\x20\\t-\\r]+', ' ', 'g')) AS body,
  trim(regexp_replace(substring(text, 1, 40), '[\\x20\\t-\\r]+', ' ', 'g')) AS head FROM q),
ok AS (SELECT doc_id, quote <> '' AND contains(body, quote) AS inside, quote <> '' AND (contains(body, quote) OR contains(head, quote)) AS shown FROM f),
pub AS (SELECT doc_id FROM b WHERE quality = 1 AND doc_id % 13 <> 0),
mem AS (SELECT doc_id, coalesce(string_agg(ev, ',' ORDER BY ev), '') AS evs FROM m GROUP BY doc_id),
evs AS (SELECT ev, left(ev, 2) AS content, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM m GROUP BY ev),
r AS (SELECT doc_id, text, coalesce(evs, '') AS evs FROM inc JOIN s USING (doc_id) LEFT JOIN mem USING (doc_id)),
apart AS (SELECT text FROM r GROUP BY text HAVING count(DISTINCT evs) > 1)
SELECT 'NEWS_SOURCE_INVALID' AS code, 'decision' AS rule, 'missing:' || doc_id AS subject FROM s WHERE doc_id NOT IN (SELECT doc_id FROM dec)
UNION ALL SELECT 'NEWS_SOURCE_INVALID', 'decision', 'unexpected:' || doc_id FROM dec WHERE doc_id NOT IN (SELECT doc_id FROM s)
UNION ALL SELECT 'NEWS_BRIEF_MISMATCH', 'period', doc_id::VARCHAR FROM s JOIN inc USING (doc_id) WHERE day NOT BETWEEN 4 AND 50
UNION ALL SELECT 'NEWS_BRIEF_MISMATCH', 'domain', doc_id::VARCHAR FROM s JOIN inc USING (doc_id) WHERE doc_id % 23 = 0
UNION ALL SELECT 'NEWS_EVIDENCE_INVALID', 'no_excerpt', doc_id::VARCHAR FROM inc WHERE doc_id NOT IN (SELECT doc_id FROM pub)
UNION ALL SELECT 'NEWS_EVIDENCE_INVALID', 'one_excerpt', ev || ':' || doc_id FROM m WHERE doc_id % 37 = 0 OR doc_id % 41 = 0
UNION ALL SELECT 'NEWS_EVIDENCE_INVALID', 'absent_quote', 'publication::' || doc_id FROM pub JOIN ok USING (doc_id) WHERE NOT shown
UNION ALL SELECT 'NEWS_EVIDENCE_INVALID', 'absent_quote', 'event:' || ev || ':' || doc_id FROM m JOIN ok USING (doc_id), range(CASE WHEN doc_id % 41 = 0 THEN 2 ELSE 1 END) WHERE doc_id % 37 <> 0 AND NOT inside
UNION ALL SELECT 'NEWS_EVENT_INVALID', 'not_included', ev || ':' || doc_id FROM m WHERE doc_id NOT IN (SELECT doc_id FROM inc)
UNION ALL SELECT 'NEWS_EVENT_INVALID', 'no_event', doc_id::VARCHAR FROM inc WHERE doc_id NOT IN (SELECT doc_id FROM m)
UNION ALL SELECT 'NEWS_DUPLICATE_EVENT', 'same_content', a.ev || ':' || min(z.ev) FROM evs a JOIN evs z ON a.content = z.content AND a.docs = z.docs AND z.ev < a.ev GROUP BY a.ev
UNION ALL SELECT 'NEWS_DUPLICATE_EVENT', 'repost_apart', doc_id::VARCHAR FROM r WHERE text IN (SELECT text FROM apart)""",
    "quote_locations": """
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(text, '[\\x20\\t-\\r]+', ' ', 'g')) || ' ' AS body FROM documents),
b AS (SELECT item_id, trim(regexp_replace(text, '[\\x20\\t-\\r]+', ' ', 'g')) AS quote FROM benchmark)
SELECT DISTINCT item_id, doc_id FROM b JOIN d ON contains(body, ' ' || quote || ' ') WHERE quote <> ''""",
    "archive_groups": """
WITH RECURSIVE k AS (
  SELECT doc_id, 'text' AS basis, lower(text) AS key FROM documents WHERE trim(text) <> '' UNION ALL SELECT doc_id, 'head', left(text, 60) FROM documents WHERE trim(left(text, 60)) <> ''
  UNION ALL SELECT doc_id, 'end', right(text, 60) FROM documents WHERE trim(right(text, 60)) <> ''),
e AS (SELECT DISTINCT basis, a.doc_id AS a, z.doc_id AS z FROM k a JOIN k z USING (basis, key) WHERE a.doc_id <> z.doc_id),
n AS (SELECT DISTINCT a, z FROM e),
w AS (SELECT DISTINCT a, a AS z FROM n UNION SELECT w.a, n.z FROM w JOIN n ON n.a = w.z)
SELECT a AS node, (SELECT min(z) FROM w WHERE w.a = x.a) AS component, string_agg(DISTINCT basis, ',' ORDER BY basis) AS bases FROM e x GROUP BY a""",
}
