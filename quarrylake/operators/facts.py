"""Fact batches: entities, relations and observations checked against declared types, against each other and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.tabular import first_failure
from quarrylake.operators.text import nfc
from quarrylake.storage import stash

#: What is wrong with a fact.
SCHEMA, DUPLICATE, TYPE, ENDPOINT = "FACT_SCHEMA_INVALID", "FACT_ID_DUPLICATE", "FACT_TYPE_UNKNOWN", "FACT_ENDPOINT_INVALID"
MEASUREMENT, SOURCE, EVIDENCE = "FACT_MEASUREMENT_INVALID", "FACT_SOURCE_INVALID", "FACT_EVIDENCE_INVALID"
KINDS = ("entity", "relation", "observation")
ENDS = {"relation": ("source_entity_id", "source_type_id", "target_entity_id", "target_type_id"), "observation": ("subject_entity_id", "subject_type_id")}
NAMES = ["id", "type_id", *ENDS["relation"], *ENDS["observation"], "source_id", "fragment_id"]
COLUMNS = ["batch", "kind", *NAMES, "value", "unit", "properties", "conditions", "evidence"]
#: White space that may not stand around a name.
SPACE = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"

TYPES = "kind string, type_id string, source_type string, target_type string, subject_type string, value_type string, unit_required boolean"
PROPERTIES = "kind string, type_id string, property_id string, value_type string, required boolean"


def _name(c: Column) -> Column:
    """A name in normal form C; null if it is empty, has space around it or holds a NUL."""
    bare = F.regexp_replace(c, SPACE, "")
    return nfc(F.when((bare != "") & (bare == c) & ~F.contains(bare, F.lit("\0")), c))


def value_matches(value: Column, value_type: Column, raw: Column | None = None) -> Column:
    """Whether a variant is of a declared type: string, integer, number, boolean, else a list of strings. A boolean is no
    number, 1.0 no integer, an infinite number none at all; null is of no type. raw is its JSON text, if whole numbers of any
    length shall count."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    long = F.coalesce(raw.rlike(r"^\s*-?[0-9]+\s*$"), F.lit(False)) if raw is not None else F.lit(False)
    # A whole number beyond 64 bits is a decimal of at least 19 digits; 1.0 is one of a single digit.
    whole = long | (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")
    finite = (kind == "DOUBLE") & (F.abs(F.try_variant_get(value, "$", "double")) < F.lit(float("inf")))
    items = F.try_variant_get(value, "$", "array<variant>")
    texts = kind.startswith("ARRAY") & F.coalesce(F.forall(items, lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")) == "STRING"), F.lit(False))
    return (
        F.when(value_type == "string", kind == "STRING").when(value_type == "integer", whole).when(value_type == "number", whole | kind.startswith("DECIMAL") | finite)
        .when(value_type == "boolean", kind == "BOOLEAN").otherwise(texts)
    )


def _shape(of: str) -> Column:
    """What the form of a fact alone breaks, one code or null; of several different faults the schema's code stands for all."""
    blank = lambda c: F.col(c).isNull()
    text = F.col("evidence").isNull() | (F.regexp_replace("evidence", SPACE, "") == "") | F.contains("evidence", F.lit("\0"))
    unit = F.coalesce((F.regexp_replace("unit", SPACE, "") == "") | F.contains("unit", F.lit("\0")), F.lit(False)) & (F.col(of) == "observation")
    ends = F.lit(False)
    for kind, columns in ENDS.items():
        ends = ends | ((F.col(of) == kind) & F.greatest(*(blank(c) for c in columns)))
    parsed = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    value = F.col("value").rlike(r"^\s*-?[0-9]+\s*$") | F.try_parse_json("value").isNotNull()
    schema = (
        blank("batch") | ~F.coalesce(F.col(of).isin(*KINDS), F.lit(False)) | blank("id") | blank("type_id") | blank("source_id")
        | ~F.coalesce(F.col("fragment_id").rlike("^[0-9a-f]{64}$"), F.lit(False))
        | ((F.col(of) == "entity") & ~parsed("properties")) | ((F.col(of) == "observation") & (~parsed("conditions") | blank("value")))
    )
    measure = (F.col(of) == "observation") & F.col("value").isNotNull() & ~F.coalesce(value, F.lit(False))
    found = F.array_compact(F.array(F.when(schema, SCHEMA), F.when(text, EVIDENCE), F.when(ends, ENDPOINT), F.when(unit | measure, MEASUREMENT)))
    return F.when(F.size(found) == 1, found[0]).when(F.size(found) > 1, SCHEMA)


def judge(facts: DataFrame, types: DataFrame, properties: DataFrame, fragments: DataFrame) -> DataFrame:
    """(batch, kind, id, code, rule) for each row of facts: the first rule it breaks, null for sound facts.

    facts has the columns of COLUMNS; properties, conditions and value are JSON texts, batch tells apart what is handed in
    together. types and properties are the declarations (TYPES, PROPERTIES; properties of entities and conditions of
    observations), fragments has (fragment_id, source_id, text). In order: form; an id that its batch has more than once; a
    type that is not declared; relation ends or an observation's subject of another type than declared, or than an entity of
    the same batch has (an entity of no row of the batch is allowed); undeclared, missing and ill-typed properties; the
    value, unit and conditions of observations; the evidence's fragment, its source, and its text, which must stand there.

    Names are compared in normal form C, evidence exactly; a name with space around it breaks the form. Declarations and values are joined
    by type and property, so that a declaration of any size is data. Texts stay with their fragments: only the facts that
    name a fragment come to it. Empty tables give an empty result; repeated rows are repeated ids; other columns are not read.
    """
    named = facts.select("batch", "kind", *(_name(F.col(c).cast("string")).alias(c) for c in NAMES), *(c for c in COLUMNS if c not in ("batch", "kind", *NAMES)))
    held = stash(named.withColumn("shape", _shape("kind")).withColumn("row", F.monotonically_increasing_id()), "facts")
    of_type = types.select("kind", "type_id", "source_type", "target_type", "subject_type", "value_type", F.coalesce("unit_required", F.lit(False)).alias("unit_required"), F.lit(True).alias("declared"))

    twice = held.groupBy("batch", "id").agg(F.count("*").alias("n")).where("n > 1").select("batch", "id", F.lit(True).alias("repeated"))
    entities = held.where("kind = 'entity'").groupBy("batch", F.col("id").alias("entity")).agg(F.max("type_id").alias("batch_type"))
    end = lambda e, t: F.struct(F.col(e).alias("entity"), F.col(t).alias("stated"))
    relation, observation = ENDS["relation"], ENDS["observation"]
    ends = F.when(F.col("kind") == "relation", F.array(end(*relation[:2]), end(*relation[2:]))).when(F.col("kind") == "observation", F.array(end(*observation)))
    met = held.select("batch", "row", F.explode(ends).alias("e")).select("batch", "row", "e.entity", "e.stated").join(entities, ["batch", "entity"])
    disagree = met.where("batch_type <> stated").select("row").distinct().withColumn("disagrees", F.lit(True))

    given = F.when(F.col("kind") == "entity", F.try_parse_json("properties")).when(F.col("kind") == "observation", F.try_parse_json("conditions"))
    pairs = held.select("row", "kind", "type_id", given.alias("given")).where("given is not null and schema_of_variant(given) like 'OBJECT%'")
    each = held.sparkSession.sql("SELECT row, kind, type_id, e.key AS property_id, e.value FROM {pairs}, LATERAL variant_explode(given) e", pairs=pairs)
    declared = properties.select("kind", "type_id", "property_id", F.col("value_type").alias("wanted"), F.coalesce("required", F.lit(False)).alias("required"))
    checked = each.join(declared, ["kind", "type_id", "property_id"], "left")
    values = checked.groupBy("row").agg(
        F.bool_or(F.col("wanted").isNull()).alias("undeclared"),
        F.bool_or(F.coalesce(~value_matches(F.col("value"), F.col("wanted")), F.lit(False))).alias("ill_typed"),
        F.count_if("required").alias("has"),
    )
    needed = declared.groupBy("kind", "type_id").agg(F.count_if("required").alias("needs"))

    cited = fragments.select("fragment_id", F.col("source_id").alias("owner"), F.col("text").alias("fragment_text"))
    quotes = held.select("row", "fragment_id", "source_id", "evidence").join(cited, "fragment_id", "left")
    sources = quotes.groupBy("row").agg(
        F.bool_or(F.coalesce(F.col("owner") == F.col("source_id"), F.lit(False))).alias("owned"),
        F.bool_or(F.coalesce((F.col("owner") == F.col("source_id")) & F.contains("fragment_text", "evidence"), F.lit(False))).alias("quoted"),
    )

    of = (
        held.join(twice, ["batch", "id"], "left").join(of_type, ["kind", "type_id"], "left").join(needed, ["kind", "type_id"], "left")
        .join(disagree, "row", "left").join(values, "row", "left").join(sources, "row", "left")
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = lambda k: F.col("kind") == k
    differs = lambda stated, wanted: ~F.col(stated).eqNullSafe(F.col(wanted))
    missing = F.coalesce("has", F.lit(0)) < F.coalesce("needs", F.lit(0))
    wrong_ends = (kind("relation") & (differs("source_type_id", "source_type") | differs("target_type_id", "target_type"))) | (kind("observation") & differs("subject_type_id", "subject_type"))
    rule = first_failure(
        [
            ("form", F.col("shape").isNotNull()),
            ("repeated_id", yes(F.col("repeated"))),
            ("undeclared_type", F.col("declared").isNull()),
            ("wrong_ends", wrong_ends | yes(F.col("disagrees"))),
            ("wrong_value", kind("observation") & ~yes(value_matches(F.try_parse_json("value"), F.col("value_type"), F.col("value")))),
            ("missing_unit", kind("observation") & F.col("unit_required") & F.col("unit").isNull()),
            ("undeclared_property", yes(F.col("undeclared"))),
            ("missing_property", kind("entity") & missing),
            ("wrong_property", yes(F.col("ill_typed"))),
            ("missing_property", missing),
            ("foreign_fragment", ~yes(F.col("owned"))),
            ("absent_text", ~yes(F.col("quoted"))),
        ]
    )
    code = (
        F.when(F.col("rule") == "form", F.col("shape")).when(F.col("rule") == "repeated_id", DUPLICATE).when(F.col("rule").isin("undeclared_type", "undeclared_property"), TYPE)
        .when(F.col("rule") == "wrong_ends", ENDPOINT).when(F.col("rule").isin("wrong_value", "missing_unit"), MEASUREMENT)
        .when(F.col("rule").isin("missing_property", "wrong_property"), F.when(kind("entity"), SCHEMA).otherwise(MEASUREMENT))
        .when(F.col("rule") == "foreign_fragment", SOURCE).when(F.col("rule") == "absent_text", EVIDENCE)
    )
    return of.withColumn("rule", rule).select("batch", "kind", "id", code.alias("code"), "rule")


def batches(judged: DataFrame) -> DataFrame:
    """(batch, facts, broken, accepted): a batch is accepted if none of its facts breaks a rule."""
    return judged.groupBy("batch").agg(F.count("*").alias("facts"), F.count("code").alias("broken"), (F.count("code") == 0).alias("accepted"))


def accepted(facts: DataFrame, judged: DataFrame) -> DataFrame:
    """The facts of accepted batches, as they were handed in."""
    return facts.join(batches(judged).where("accepted").select("batch"), "batch", "left_semi")
