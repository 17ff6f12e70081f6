"""Ontologies held as tables: ids, references, versions and coverage checked for many ontologies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.facts import SPACE
from quarrylake.operators.tabular import first_failure
from quarrylake.operators.text import nfc
from quarrylake.storage import stash

#: What is wrong with an ontology, kinds of elements, types of values, the form of a version.
SCHEMA, DUPLICATE, REFERENCE, VERSION = "ONTOLOGY_SCHEMA_INVALID", "ONTOLOGY_ID_DUPLICATE", "ONTOLOGY_REFERENCE_INVALID", "ONTOLOGY_VERSION_CONFLICT"
KINDS = ("entity", "property", "relation", "observation", "condition")
VALUE_TYPES = ("string", "integer", "number", "boolean", "string_list")
SEMANTIC = r"^(0|[1-9][0-9]{0,17})\.(0|[1-9][0-9]{0,17})\.(0|[1-9][0-9]{0,17})$"
ELEMENTS = "ontology string, kind string, id string, label string, value_type string, source_type string, target_type string, subject_type string"
COVERAGE = "ontology string, question_id string, element_id string"
DOCUMENTS = "ontology string, version string, base_version string, approved_version string"


def _sound(c: Column) -> Column:
    """A text that is not empty, has no space around it and no NUL."""
    return F.coalesce((c != "") & (F.regexp_replace(c, SPACE, "") == c) & ~F.contains(c, F.lit("\0")), F.lit(False))


def _version(c: Column) -> Column:
    return F.coalesce(c.rlike(SEMANTIC), F.lit(False))


def judge(documents: DataFrame, elements: DataFrame, coverage: DataFrame) -> DataFrame:
    """(ontology, elements, malformed, repeated_ids, unknown_references, code) for each row of documents.

    documents has (ontology, version, base_version, approved_version), elements (ELEMENTS) a row for each entity type, its
    properties, relation type, observation type and its conditions, coverage (COVERAGE) a row for each element that answers
    a question. Counted are elements and coverage rows of the wrong form, ids that an ontology has more than once in all kinds
    together, ends and subjects that are no entity type of it, and covered elements that it does not have. Ids are compared
    in normal form C. code is the first that applies: form (versions, and no entity type or no coverage, included), repeated
    ids, references, and a base version that is not the approved one or is the version itself; null for sound ontologies.

    Each count is an aggregate by ontology and id, so one large ontology is spread over tasks. Elements of ontologies without
    a document are left out; empty tables give an empty result; rows of documents that repeat each get their row.
    """
    made = lambda *names: [nfc(F.col(c)).alias(c) for c in names]
    held = stash(elements.select("ontology", "kind", "label", "value_type", F.col("id").alias("raw"), *made("id", "source_type", "target_type", "subject_type")), "ontology")
    typed = F.col("kind").isin("property", "observation", "condition")
    sound = (
        F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) & _sound(F.col("raw")) & _sound(F.col("label")) & (~typed | F.coalesce(F.col("value_type").isin(*VALUE_TYPES), F.lit(False)))
        & ((F.col("kind") != "relation") | (_sound(F.col("source_type")) & _sound(F.col("target_type")))) & ((F.col("kind") != "observation") | _sound(F.col("subject_type")))
    )
    shape = held.groupBy("ontology").agg(F.count("*").alias("elements"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("malformed"), F.count_if(F.col("kind") == "entity").alias("entities"))
    ids = held.where("id is not null").groupBy("ontology", "id").agg(F.count("*").alias("n"), F.bool_or(F.col("kind") == "entity").alias("is_entity"))
    repeated = ids.where("n > 1").groupBy("ontology").agg(F.count("*").alias("repeated"))

    ends = F.when(F.col("kind") == "relation", F.array("source_type", "target_type")).when(F.col("kind") == "observation", F.array("subject_type"))
    wanted = held.select("ontology", F.explode(ends).alias("id")).where("id is not null").groupBy("ontology", "id").agg(F.count("*").alias("uses"))
    dangling = wanted.join(ids.where("is_entity").select("ontology", "id"), ["ontology", "id"], "left_anti")
    covers = coverage.select("ontology", "question_id", nfc(F.col("element_id")).alias("id"))
    missing = covers.groupBy("ontology", "id").agg(F.count("*").alias("uses")).where("id is not null").join(ids.select("ontology", "id"), ["ontology", "id"], "left_anti")
    unknown = dangling.unionByName(missing).groupBy("ontology").agg(F.sum("uses").alias("unknown"))
    covered = covers.groupBy("ontology").agg(F.count("*").alias("covered"), F.count_if(~_sound(F.col("question_id")) | ~_sound(F.col("id"))).alias("malformed_coverage"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    every = documents.select("ontology", "version", "base_version", "approved_version")
    for df in (shape, repeated, unknown, covered):
        every = every.join(df, "ontology", "left")
    malformed = zero("malformed") + zero("malformed_coverage")
    versions = _version(F.col("version")) & (F.col("base_version").isNull() | _version(F.col("base_version")))
    code = first_failure([
        (SCHEMA, ~_sound(F.col("ontology")) | ~versions | (malformed > 0) | (zero("entities") == 0) | (zero("covered") == 0)),
        (DUPLICATE, zero("repeated") > 0), (REFERENCE, zero("unknown") > 0),
        (VERSION, ~F.col("base_version").eqNullSafe(F.col("approved_version")) | F.col("base_version").eqNullSafe(F.col("version"))),
    ])
    return every.select("ontology", zero("elements").alias("elements"), malformed.alias("malformed"), zero("repeated").alias("repeated_ids"), zero("unknown").alias("unknown_references"), code.alias("code"))
