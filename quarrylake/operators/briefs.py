"""What a news brief rests on and is judged by: dictionaries, terms found in its query, the archive's period and sources,
limitations, and the critique of its events. All checks run over many briefs and list every problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.facts import SPACE
from quarrylake.operators.tabular import first_failure

#: Most characters of a text, an excerpt and a category.
LIMITS = {"text": 4_000, "excerpt": 12_000, "category": 200}
RESOLUTIONS = ("resolved", "unresolved")


def blank(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, SPACE, "") == "", F.lit(True))


def text_problem(c: Column, kind: str) -> Column:
    """missing, blank, nul, untrimmed or too_long for a text of one of the kinds of LIMITS; null if nothing is wrong."""
    checks = [
        ("missing", c.isNull()),
        ("blank", blank(c)),
        ("nul", F.contains(c, F.lit("\0"))),
        ("untrimmed", F.regexp_replace(c, SPACE, "") != c),
        ("too_long", F.length(c) > LIMITS[kind]),
    ]
    return first_failure(checks)


def distinct_in_order(ids: Column) -> Column:
    """The list with the first of equal items only; an absent list is empty."""
    return F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))


def limitations(listed: Column, date_limitation: Column) -> Column:
    """A publication's limitations and that of its date, if it has one that is not empty, sorted and each once."""
    of_date = F.when(F.coalesce(date_limitation, F.lit("")) != "", F.array(date_limitation)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: x.isNotNull()), of_date))


def period(records: DataFrame, day: str, *by: str) -> DataFrame:
    """(by, start, end, publications): first and last day and number of records; days that are null count as records only."""
    return records.groupBy(*by).agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("publications"))


def sources(publications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, url, publications, first), (source, url, publication_id)) of the included (publication_id, source, url, decision).

    The second has the members of each entry, one row each, as a source may have any number; nulls form an entry of their own.
    """
    included = publications.where("decision = 'include'").select("source", "url", "publication_id")
    return included.groupBy("source", "url").agg(F.count("*").alias("publications"), F.min("publication_id").alias("first")), included


def dictionaries(files: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, version, id, entry), (path, code)) of JSON files (path, content) that hold a version and a list of entries
    with ids, in the field that wanted (path, field) names.

    Codes: MISSING_FILE (wanted, not there), INVALID_INPUT (no object, a blank version, a list that is missing or empty, an
    entry that is no object or whose id is blank), DUPLICATE_ID. Only entries of files without a problem are returned.
    """
    held = wanted.join(files.select("path", "content").withColumn("there", F.lit(True)), "path", "left")
    value = held.withColumn("value", F.try_parse_json("content"))
    typed = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    text = lambda c, path: F.when(typed(F.try_variant_get(c, path, "variant")) == "STRING", F.try_variant_get(c, path, "string"))
    named = F.map_filter(F.try_variant_get("value", "$", "map<string,variant>"), lambda k, _: k == F.col("field"))
    opened = value.withColumn("version", text(F.col("value"), "$.version")).withColumn("list", F.get(F.map_values(named), F.lit(0)))
    bad = ~typed(F.col("value")).startswith("OBJECT") | blank(F.col("version")) | F.coalesce(~typed(F.col("list")).startswith("ARRAY"), F.lit(True))
    judged = opened.withColumn("code", first_failure([("MISSING_FILE", F.col("there").isNull()), ("INVALID_INPUT", bad)]))
    spark, whole = files.sparkSession, judged.where("code is null").select("path", "version", "list")
    entries = spark.sql("SELECT path, version, e.value AS entry FROM {held}, LATERAL variant_explode(list) e", held=whole)
    entries = entries.withColumn("id", text(F.col("entry"), "$.id")).withColumn("bad", blank(F.col("id")))
    empty = whole.join(entries.select("path").distinct(), "path", "left_anti").select("path", F.lit("INVALID_INPUT").alias("code"))
    faulty = entries.where("bad").select("path", F.lit("INVALID_INPUT").alias("code")).distinct()
    repeated = entries.where("not bad").groupBy("path", "id").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("DUPLICATE_ID").alias("code")).distinct()
    problems = judged.where("code is not null").select("path", "code").unionByName(empty).unionByName(faulty).unionByName(repeated)
    return entries.join(problems.select("path").distinct(), "path", "left_anti").select("path", "version", "id", "entry"), problems


def terminology_problems(briefs: DataFrame, mentions: DataFrame, terms: DataFrame, categories: DataFrame, versions: dict[str, str]) -> DataFrame:
    """(brief_id, place, code): the first rule that a brief (brief_id, query, asked, terms_version, taxonomy_version) or one of its
    mentions (brief_id, place, kind, term_id, category_id, reason, fragment) breaks; place is null for the brief itself.

    A brief must ask its query and name the dictionaries' versions. A detected term or an expansion needs a known term_id, a
    reason and a fragment, which must be part of the query if it is detected; an exclusion needs a reason and a known term_id or
    category_id, and neither may be unknown. Mentions of no brief are UNKNOWN_ID.
    """
    other = ~F.col("asked").eqNullSafe(F.col("query")) | ~F.col("terms_version").eqNullSafe(F.lit(versions["terms"])) | ~F.col("taxonomy_version").eqNullSafe(F.lit(versions["taxonomy"]))
    whole = briefs.where(other).select("brief_id", F.lit(None).cast("long").alias("place"), F.lit("VERSION_MISMATCH").alias("code"))
    known = lambda df, c, into: df.select(c).distinct().withColumn(into, F.lit(True))
    held = mentions.join(known(terms, "term_id", "term"), "term_id", "left").join(known(categories, "category_id", "category"), "category_id", "left")
    held = held.join(briefs.select("brief_id", "query", F.lit(True).alias("brief")), "brief_id", "left")
    excluded, no = F.col("kind") == "exclusion", lambda c: F.col(c).isNull()
    code = first_failure(
        [
            ("UNKNOWN_ID", no("brief")),
            ("INVALID_INPUT", ~F.coalesce(F.col("kind").isin("detected", "expansion", "exclusion"), F.lit(False)) | blank(F.col("reason"))),
            ("INVALID_INPUT", F.when(excluded, no("term_id") & no("category_id")).otherwise(blank(F.col("term_id")) | blank(F.col("fragment")))),
            ("UNKNOWN_ID", (~no("term_id") & no("term")) | (excluded & ~no("category_id") & no("category"))),
            ("INVALID_EVIDENCE", (F.col("kind") == "detected") & ~F.coalesce(F.contains("query", F.col("fragment")), F.lit(False))),
        ]
    )
    return whole.unionByName(held.select("brief_id", "place", code.alias("code")).where("code is not null"))


def critique_problems(notes: DataFrame, targets: DataFrame, reviewed: DataFrame, events: DataFrame, sources: DataFrame, cycle: int) -> DataFrame:
    """(code, rule, subject) of a critique: notes (note_id, issue, action, resolution, resolution_reason), what they point at
    (note_id, kind, target), the events reviewed with their sources (event_id, source_id), and the events and sources there are.

    cycle, the number of corrections, is 0 or 1. Rules: note ids are there and unique, their texts not blank, the resolution
    one of RESOLUTIONS; targets belong to notes; sources exist; a target event is an event or a reviewed one, and one that was
    removed, reviewed but no longer an event, needs a resolved note in a correction; reviewed events have existing sources.
    """
    found = lambda rows, rule, *subject: rows.select(F.lit("NEWS_CRITIQUE_INVALID").alias("code"), F.lit(rule).alias("rule"), F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in subject)).alias("subject"))
    repeated = notes.groupBy("note_id").agg(F.count("*").alias("n")).where("n > 1")
    texts = blank(F.col("note_id").cast("string")) | blank(F.col("issue")) | blank(F.col("action")) | blank(F.col("resolution_reason"))
    judged = found(repeated, "repeated_note", "note_id").unionByName(found(notes.where(texts), "blank_text", "note_id"))
    judged = judged.unionByName(found(notes.where(~F.coalesce(F.col("resolution").isin(*RESOLUTIONS), F.lit(False))), "resolution", "note_id"))
    judged = judged.unionByName(found(targets.join(notes.select("note_id").distinct(), "note_id", "left_anti"), "unknown_note", "note_id"))
    there = sources.select(F.col("source_id").alias("target")).distinct()
    at_sources = targets.where("kind = 'source'")
    judged = judged.unionByName(found(at_sources.join(there, "target", "left_anti"), "unknown_source", "note_id", "target"))
    now = events.select(F.col("event_id").alias("target")).distinct()
    gone = targets.where("kind = 'event'").join(now, "target", "left_anti")
    before = reviewed.select(F.col("event_id").alias("target")).distinct()
    judged = judged.unionByName(found(gone.join(before, "target", "left_anti"), "unknown_event", "note_id", "target"))
    settled = notes.where((F.col("resolution") == "resolved") & F.lit(cycle == 1)).select("note_id").distinct()
    judged = judged.unionByName(found(gone.join(before, "target", "left_semi").join(settled, "note_id", "left_anti"), "removed_event", "note_id", "target"))
    shown = reviewed.where("source_id is not null").withColumnRenamed("source_id", "target")
    judged = judged.unionByName(found(shown.join(there, "target", "left_anti"), "reviewed_source", "event_id", "target"))
    if cycle not in (0, 1):
        one = notes.sparkSession.range(1)
        judged = judged.unionByName(one.select(F.lit("NEWS_CRITIQUE_INVALID").alias("code"), F.lit("cycle").alias("rule"), F.lit(str(cycle)).alias("subject")))
    return judged
