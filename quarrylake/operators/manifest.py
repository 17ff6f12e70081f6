"""Manifests of well records: walked to any depth, judged record by record, and turned into a graph that is loaded whole or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.operators import graph
from quarrylake.operators.tabular import first_failure
from quarrylake.sources import publish
from quarrylake.storage import stash

#: The record types that become nodes with the group of each, the envelope, and the forms of kinds and ids.
SUPPORTED = {"Well": "master-data", "Wellbore": "master-data", "WellLog": "work-product-component"}
ENVELOPE = "osdu:wks:Manifest:1.0.0"
KIND = r"^[^:]+:wks:([a-z0-9-]+)--([A-Za-z0-9-]+):[0-9]+\.[0-9]+\.[0-9]+$"
ID = r"^osdu:([a-z0-9-]+)--([A-Za-z0-9-]+):[^:\s].*$"
FIELDS = {"Well": ["FacilityID"], "Wellbore": ["FacilityID", "SequenceNumber"], "WellLog": ["TopMeasuredDepth", "BottomMeasuredDepth"]}
#: child type: (edge, field of the parent's id, parent type)
PARENTS = {"Wellbore": ("BELONGS_TO_WELL", "WellID", "Well"), "WellLog": ("BELONGS_TO_WELLBORE", "WellboreID", "Wellbore")}
SURROGATE, FALLBACK = "surrogate-key:", "urn:osdu-demo:WellLog:"
ISSUES = "source string, osdu_id string, reason string, fatal boolean"
#: Levels that a round descends, and most rows in a file of what lies deeper: a reader holds thousands of rows of a file at once.
LEVELS, DEEP_ROWS = 8, 256
NODES = "array<struct<place:array<int>,value:variant,scope:string>>"


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column, field: str) -> Column:
    """A field of a variant if it is a string."""
    held = F.try_variant_get(v, f"$.{field}", "variant")
    return F.when(_type(held) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))


def _bare(c: Column) -> Column:
    """A text without white space around it; null if nothing is left."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def _record_type(kind: Column) -> Column:
    """The supported type that a kind names together with its group; null for all other kinds."""
    group, of = F.regexp_extract(kind, KIND, 1), F.regexp_extract(kind, KIND, 2)
    known = F.create_map(*(F.lit(x) for pair in SUPPORTED.items() for x in pair))
    return F.when(F.try_element_at(known, of) == group, of)


def _node(place: Column, value: Column) -> Column:
    """A value with its place and what is done with it. The kinds of all supported types have --Well in them; single values
    have no kind and no parts, so descending into them ends there."""
    kind, own_id = (F.try_variant_get(value, f"$.{field}", "string") for field in ("kind", "id"))
    looks = F.coalesce(F.contains(own_id, F.lit("--Well")), F.lit(False)) | F.coalesce(F.contains(kind, F.lit("--Well")), F.lit(False))
    scope = F.when(value.isNull(), "broken").when(kind == ENVELOPE, "descend").when(looks, "record").when(_text(value, "kind").isNotNull(), "skip").otherwise("descend")
    return F.struct(place.alias("place"), value.alias("value"), scope.alias("scope"))


def _below(nodes: Column) -> Column:
    """The nodes with the parts of those to descend into in their place; skipped ones go, all others stay."""

    def parts(node: Column) -> Column:
        of = F.coalesce(F.try_variant_get(node["value"], "$", "array<variant>"), F.map_values(F.try_variant_get(node["value"], "$", "map<string,variant>")))
        below = F.transform(of, lambda value, at: _node(F.concat(node["place"], F.array(at)), value))
        return F.coalesce(F.when(node["scope"] == "descend", below).when(node["scope"] != "skip", F.array(node)), F.array().cast(NODES))

    return F.flatten(F.transform(nodes, parts))


def walk(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records (path, place, record), issues) of JSON files (path, content).

    Lists, envelopes and objects without a kind are descended into, to any depth: LEVELS at a time, in the tasks that parse
    the files, so a file is held by itself and never written again; only what lies deeper is written for a next round.
    Objects whose kind names a supported type, or whose id or kind looks like one, are records; others with a kind are out of
    scope. place has the positions on the way down: records sort by it in document order, an object's fields by name. A file
    that is no UTF-8 or no JSON, that repeats a field of an object, or that holds no record is a fatal issue. Empty files are
    not seen by a scan.
    """
    text = F.regexp_replace(F.col("content").cast("string"), r"^\x{FEFF}", "")
    parsed = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.try_parse_json(text))
    left, rows, records, broken = files.select("path", F.array().cast("array<int>").alias("place"), parsed.alias("value")), None, None, None
    while records is None or left.head(1):
        nodes = F.array(_node(F.col("place"), F.col("value")))
        for _ in range(LEVELS):
            nodes = _below(nodes)
        found = stash(left.select("path", F.inline(F.filter(nodes, lambda n: n["scope"] != "skip"))), "manifest", rows)
        left, rows, own = found.where("scope = 'descend'").drop("scope"), DEEP_ROWS, found.where("scope = 'record'").select("path", "place", F.col("value").alias("record"))
        records, broken = (own, found.where("scope = 'broken'").select("path")) if records is None else (records.unionByName(own), broken)
    seen = broken.unionByName(records.select("path")).distinct()
    without = files.select("path").join(seen, "path", "left_anti")
    issue = lambda df, reason: df.select(F.col("path").alias("source"), F.lit(None).cast("string").alias("osdu_id"), F.lit(reason).alias("reason"), F.lit(True).alias("fatal"))
    return records, issue(broken, "invalid JSON").unionByName(issue(without, "no supported records"))


def judge(records: DataFrame) -> DataFrame:
    """(path, place, label, key, name, kind, parent, properties, reason) of records: what each becomes, or why it does not.

    Reasons in order: unsupported kind, missing data, wrong id, missing id, missing name, invalid parent. A log without an id
    of its own gets one from its wellbore, name and kind. properties has the scalars of the type's fields, first letter small.
    """
    data = F.try_variant_get("record", "$.data", "variant")
    held = records.select("path", "place", _bare(_text(F.col("record"), "kind")).alias("kind"), _bare(graph.normalize_id(_bare(_text(F.col("record"), "id")))).alias("id"), F.when(_type(data).startswith("OBJECT"), data).alias("data"))
    held = held.withColumn("label", _record_type(F.col("kind")))
    is_of = lambda c, of: F.coalesce((F.regexp_extract(c, ID, 1) == F.lit(SUPPORTED[of])) & (F.regexp_extract(c, ID, 2) == F.lit(of)), F.lit(False))
    own = F.lit(False)
    for of in SUPPORTED:
        own = own | ((F.col("label") == of) & is_of(F.col("id"), of))
    parent, right_parent, edge = F.lit(None).cast("string"), F.col("label") == "Well", F.lit(None).cast("string")
    for child, (edge_type, field, of) in PARENTS.items():
        found = _bare(graph.normalize_id(_bare(_text(F.col("data"), field))))
        parent = F.when(F.col("label") == child, found).otherwise(parent)
        edge = F.when(F.col("label") == child, F.lit(edge_type)).otherwise(edge)
        right_parent = right_parent | ((F.col("label") == child) & is_of(found, of))
    log_name = _bare(_text(F.col("data"), "Name"))
    name = F.coalesce(_bare(_text(F.col("data"), "FacilityName")), log_name)
    nameless = (F.col("label") == "WellLog") & (F.col("id").isNull() | F.col("id").startswith(SURROGATE))
    held = held.withColumn("parent", parent).withColumn("edge", edge).withColumn("right_parent", right_parent).withColumn("log_name", log_name).withColumn("name", name).withColumn("nameless", nameless).withColumn("own", own)
    made = F.concat(F.lit(FALLBACK), graph.surrogate_key(F.col("parent"), F.col("log_name"), F.col("kind")))
    key = F.when(F.col("nameless"), F.when(F.col("right_parent") & F.col("log_name").isNotNull(), made)).otherwise(F.col("id"))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))

    def scalar(field: str) -> Column:
        v = F.try_variant_get("data", f"$.{field}", "variant")
        number = F.try_variant_get("data", f"$.{field}", "double")
        finite = _type(v).rlike("^(BIGINT|DECIMAL)") | ((_type(v) == "DOUBLE") & (F.abs(number) < F.lit(float("inf"))))
        return F.when(_type(v).isin("STRING", "BOOLEAN") | finite, F.try_variant_get("data", f"$.{field}", "string"))

    values = [entry("osduId", F.col("key")), entry("name", F.col("name")), entry("kind", F.col("kind"))]
    for field in dict.fromkeys(f for fields in FIELDS.values() for f in fields):
        of = [label for label, fields in FIELDS.items() if field in fields]
        values.append(entry(field[0].lower() + field[1:], F.when(F.col("label").isin(of), scalar(field))))
    reason = first_failure(
        [
            ("unsupported kind", F.col("label").isNull()),
            ("missing data", F.col("data").isNull()),
            ("wrong id", ~F.col("nameless") & ~F.col("own")),
            ("missing id", F.col("key").isNull()),
            ("missing name", F.col("name").isNull()),
            ("invalid parent", ~F.col("right_parent")),
        ]
    )
    properties = F.map_from_entries(F.filter(F.array(*values), lambda e: e["value"].isNotNull()))
    judged = held.withColumn("key", key).withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("properties", properties)
    return judged.select("path", "place", "label", "key", "name", "kind", "edge", "parent", "properties", F.nullif("reason", F.lit("")).alias("reason"))


def build(files: DataFrame) -> dict[str, DataFrame]:
    """The graph of JSON files: nodes (label, key, properties), edges (type, start_key, end_key), issues, and the judged records.

    Of records with one id the first by path and place is the node, whose edge counts; others with another content are issues.
    Fatal are broken files, edges without an end or between other labels than declared, and a graph that lacks one of the
    labels or edge types altogether.
    """
    spark = files.sparkSession
    records, issues = walk(files)
    judged = stash(judge(records), "manifest-records")
    source = F.concat("path", F.lit("#"), F.array_join(F.col("place").cast("array<string>"), "."))
    sound = judged.where("reason is null").withColumn("content", F.to_json(F.array_sort(F.map_entries("properties")))).withColumn("source", source)
    first, seen = graph.first_wins(sound.select("label", "key", "properties", "content", "edge", "parent", "path", "place", "source"), ["key"], ["path", "place"], ["label", "content", "parent"])
    first = stash(first, "manifest-nodes")
    nodes = first.select("label", "key", "properties")
    linked = first.where("edge is not null").select(F.col("edge").alias("type"), F.col("key").alias("start_key"), F.col("parent").alias("end_key"))
    rejected = judged.where("reason is not null").select(source.alias("source"), F.col("key").alias("osdu_id"), "reason", F.lit(False).alias("fatal"))
    clashing = seen.where("conflicting").select(F.lit("<records>").alias("source"), F.col("key").alias("osdu_id"), F.lit("other content for the same id").alias("reason"), F.lit(False).alias("fatal"))
    issues, edges = issues.unionByName(rejected).unionByName(clashing), None
    for child, (edge, _, parent) in PARENTS.items():
        good, bad = graph.resolve_edges(linked.where(F.col("type") == edge), nodes, child, parent)
        edges = good if edges is None else edges.unionByName(good)
        issues = issues.unionByName(bad.select(F.lit("<edges>").alias("source"), F.col("start_key").alias("osdu_id"), F.concat("type", F.lit(" "), "reason").alias("reason"), F.lit(True).alias("fatal")))
    edges = stash(edges, "manifest-edges")
    for wanted, held in ((SUPPORTED, nodes.select(F.col("label").alias("name"))), ([e for e, _, _ in PARENTS.values()], edges.select(F.col("type").alias("name")))):
        needed = spark.createDataFrame([(w,) for w in wanted], "name string").join(held.distinct(), "name", "left_anti")
        issues = issues.unionByName(needed.select(F.lit("<graph>").alias("source"), F.lit(None).cast("string").alias("osdu_id"), F.concat(F.lit("nothing of type "), "name").alias("reason"), F.lit(True).alias("fatal")))
    return {"nodes": nodes, "edges": edges, "issues": stash(issues, "manifest-issues"), "records": judged}


def report(built: dict[str, DataFrame]) -> DataFrame:
    """(measure, n) of a built graph: records seen, nodes by label, edges by type, issues, fatal issues, and passed as 1 or 0."""
    counted = lambda df, name: df.groupBy(name.alias("measure")).agg(F.count("*").alias("n"))
    whole = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    fatal = built["issues"].where("fatal")
    passed = fatal.agg((F.count("*") == 0).cast("long").alias("n")).select(F.lit("passed").alias("measure"), "n")
    return (
        whole(built["records"], "records").unionByName(counted(built["nodes"], F.col("label"))).unionByName(counted(built["edges"], F.col("type")))
        .unionByName(whole(built["issues"], "issues")).unionByName(whole(fatal, "fatal")).unionByName(passed)
    )


def load(spark: SparkSession, built: dict[str, DataFrame], path: str) -> dict:
    """Publish a built graph at path; fatal issues, repeated nodes, dangling edges or rows that differ from the built ones
    refuse the load and leave what was published. The marker's counts are those read back after the write."""
    expected = {name: built[name].count() for name in ("nodes", "edges")}
    tables = {name: built[name] for name in ("nodes", "edges")}
    return publish.publish(spark, path, tables, {"nodes": ["key"]}, [("edges", "start_key", "nodes", "key"), ("edges", "end_key", "nodes", "key")], issues=built["issues"], expected=expected)
