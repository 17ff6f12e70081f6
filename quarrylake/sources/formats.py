"""Catalogues of seismic and well files: all fields of SEG-Y headers and of WITSML 1.4.1.1 wells, with a status for each file."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.tabular import first_failure

#: Fixed values of the SEG-Y standard: name, first byte (from 1) and size of the fields of the binary header.
SEGY_FIELDS = (
    ("JobID", 3201, 4), ("LineNumber", 3205, 4), ("ReelNumber", 3209, 4), ("Traces", 3213, 2), ("AuxTraces", 3215, 2), ("Interval", 3217, 2), ("IntervalOriginal", 3219, 2), ("Samples", 3221, 2),
    ("SamplesOriginal", 3223, 2), ("Format", 3225, 2), ("EnsembleFold", 3227, 2), ("SortingCode", 3229, 2), ("MeasurementSystem", 3255, 2), ("SEGYRevision", 3501, 1), ("SEGYRevisionMinor", 3502, 1),
    ("TraceFlag", 3503, 2), ("ExtendedHeaders", 3505, 2),
)
SEGY_TEXT, SEGY_HEAD = 3200, 3600

#: Fixed values of WITSML: namespaces, and the texts, measures and coordinates of a well that are kept if they are there.
WITSML_NAMESPACE, WITSML_OLDER, WITSML_NEWER = "http://www.witsml.org/schemas/1series", "http://www.witsml.org/schemas/131", "http://www.energistics.org/energyml/data/witsmlv2"
TEXTS = (
    "nameLegal", "numLicense", "numGovt", "country", "region", "block", "district", "operator", "operatorDiv", "statusWell", "purposeWell", "fluidWell", "directionWell", "wellDatum", "dTimSpud",
)
MEASURES, COORDINATES = ("groundElevation", "waterDepth", "pcInterest"), ("latitude", "longitude", "easting", "northing")


def segy(files: DataFrame, marker: str) -> DataFrame:
    """(path, status, reason, version, text, marked, header) of SEG-Y files (path, content), one row each.

    header maps the names of SEGY_FIELDS to big-endian signed numbers, revisions unsigned; text is the first 3,200 bytes as
    ASCII if the marker is in it, else as EBCDIC (code page 500), and marked whether the marker is in the result. Status is
    empty (no bytes or null), corrupt_input (under 3,600 bytes), unsupported_version (revision 2 and later, fields given) or
    ok. Traces are not looked at.
    """
    size = F.coalesce(F.length("content"), F.lit(0))
    held = files.select("path", size.alias("bytes"), F.when(size >= SEGY_HEAD, F.substring("content", 1, SEGY_HEAD)).alias("head"))

    def number(at: int, width: int) -> Column:
        plain = F.conv(F.hex(F.substring("head", at, width)), 16, 10).cast("long")
        return F.when(plain >= 1 << 8 * width - 1, plain - (1 << 8 * width)).otherwise(plain) if width > 1 else plain

    @F.pandas_udf("string")
    def text(heads: pd.Series) -> pd.Series:
        def read(head: bytes | None) -> str | None:
            if head is None:
                return None
            plain = head.decode("ascii", "replace")
            return plain if marker in plain else head.decode("cp500", "replace")

        return heads.map(read)

    fields = F.map_from_arrays(F.array(*(F.lit(n) for n, _, _ in SEGY_FIELDS)), F.array(*(number(at, w) for _, at, w in SEGY_FIELDS)))
    rows = held.withColumn("header", F.when(F.col("head").isNotNull(), fields)).withColumn("text", text(F.substring("head", 1, SEGY_TEXT)))
    major, minor = F.col("header")["SEGYRevision"], F.col("header")["SEGYRevisionMinor"]
    wrong = [("empty", F.col("bytes") == 0), ("corrupt_input", F.col("bytes") < SEGY_HEAD), ("unsupported_version", major >= 2)]
    reason = F.when(F.col("bytes") == 0, "empty_file").when(F.col("bytes") < SEGY_HEAD, "truncated_header").when(major >= 2, "segy_revision_ge_2")
    version = F.concat(major.cast("string"), F.lit("."), minor.cast("string"))
    return rows.select("path", F.coalesce(first_failure(wrong), F.lit("ok")).alias("status"), reason.alias("reason"), version.alias("version"), "text", F.contains("text", F.lit(marker)).alias("marked"), "header")


def _bare(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def _schema(root: str) -> str:
    measured = "struct<_VALUE:string,_uom:string>"
    well = (
        ["_uid:string", f"wellheadElevation:{measured}"] + [f"{n}:string" for n in ("name", "field", "timeZone", *TEXTS)] + [f"{n}:{measured}" for n in MEASURES]
        + [f"wellLocation:struct<{','.join(f'{n}:{measured}' for n in COORDINATES)}>"]
    )
    if root == "well":
        return ",".join(n.replace(":", " ", 1) for n in [*well, "_corrupt_record:string"])
    return f"well array<struct<{','.join(well)}>>, _corrupt_record string"


def witsml(files: DataFrame) -> DataFrame:
    """Wells of WITSML documents (path, content): one row for each well, and one with a null place for a document without any.

    Columns: path, status, reason, version of the document; place (from 0), uid, name, field, time_zone, elevation (value,
    uom); texts, measures and location: maps of what is there of TEXTS, MEASURES and COORDINATES; missing: paths of what a
    complete well has and this one lacks, with wells[i] before those of later wells. Texts are trimmed, blank ones are absent.

    Status: empty (no bytes, or no well), corrupt_input, unsupported_version, incomplete (the first well lacks something) or
    ok. The root is well or any element with wells in it; a document without a namespace and version is taken as 1.4.1.1.
    """
    xml = files.select("path", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("xml"))
    root = F.regexp_extract("xml", r"^\x{FEFF}?\s*(?:<\?[\s\S]*?\?>\s*|<!--[\s\S]*?-->\s*|<!DOCTYPE[^>]*>\s*)*(<[A-Za-z_][^>]*>)", 1)
    xml = xml.withColumn("root", root)
    xml = xml.withColumn("prefix", F.regexp_extract("root", r"^<([\w.-]+):", 1)).withColumn("tag", F.regexp_extract("root", r"^<(?:[\w.-]+:)?([\w.-]+)", 1))
    attribute: Callable[[str], Column] = lambda name: F.nullif(F.regexp_extract("root", rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    prefixed = F.expr("nullif(regexp_extract(root, concat('\\\\sxmlns:\\\\Q', prefix, '\\\\E\\\\s*=\\\\s*[\"'']([^\"'']*)[\"'']'), 1), '')")
    namespace = F.when(F.col("prefix") == "", attribute("xmlns")).otherwise(prefixed)
    xml = xml.withColumn("ns", namespace).withColumn("version", F.coalesce(attribute("version"), attribute("schemaVersion")))
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreSurroundingSpaces": "false"}
    one = F.when(F.col("tag") == "well", F.from_xml("xml", _schema("well"), options))
    many = F.when((F.col("tag") != "well") & (F.col("tag") != ""), F.from_xml("xml", _schema("wells"), options))
    parsed = xml.withColumn("one", one).withColumn("many", many)
    fields = [f for f in parsed.schema["one"].dataType.names if f != "_corrupt_record"]
    alone = F.struct(*(F.col("one")[f].alias(f) for f in fields))
    several = F.transform("many.well", lambda w: F.struct(*(w[f].alias(f) for f in fields)))
    corrupt = (F.col("tag") == "") | F.col("one._corrupt_record").isNotNull() | F.col("many._corrupt_record").isNotNull()
    parsed = parsed.withColumn("wells", F.when(F.col("tag") == "well", F.array(alone)).otherwise(several))

    newer, older = (F.col("ns") == WITSML_NEWER) | F.startswith("version", F.lit("2")), (F.col("ns") == WITSML_OLDER) | (F.col("version") == "1.3.1.1")
    strange = (F.col("ns") != WITSML_NAMESPACE) | (F.col("version") != "1.4.1.1")
    reason = first_failure(
        [
            ("empty_file", F.col("xml") == ""), ("not_well_formed", corrupt), ("witsml_2x", newer), ("witsml_1.3.1.1", older), ("witsml_unexpected_version", strange),
            ("no_well_object", F.coalesce(F.size("wells") == 0, F.lit(True))),
        ]
    )
    parsed = parsed.withColumn("reason", reason)
    rows = parsed.select("path", "reason", "ns", "version", F.posexplode_outer(F.when(F.col("reason").isNull(), F.col("wells"))).alias("place", "w"))

    measure = lambda c: F.when(_bare(c["_VALUE"]).isNotNull(), F.struct(_bare(c["_VALUE"]).alias("value"), c["_uom"].alias("uom")))
    kept = lambda pairs: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in pairs)), lambda e: e["value"].isNotNull()))
    texts = kept([(n, _bare(F.col(f"w.{n}"))) for n in TEXTS])
    elevation = measure(F.col("w.wellheadElevation"))
    rows = rows.select(
        "path", "reason", "ns", "version", "place", F.col("w._uid").alias("uid"), _bare(F.col("w.name")).alias("name"), _bare(F.col("w.field")).alias("field"), _bare(F.col("w.timeZone")).alias("time_zone"),
        elevation.alias("elevation"), texts.alias("texts"), kept([(n, measure(F.col(f"w.{n}"))) for n in MEASURES]).alias("measures"), kept([(n, measure(F.col(f"w.wellLocation.{n}"))) for n in COORDINATES]).alias("location"),
    )
    absent = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    of_elevation = F.when(F.col("elevation").isNull(), "wellheadElevation").when(F.coalesce(F.col("elevation.uom"), F.lit("")) == "", "wellheadElevation.uom")
    lacking = F.array(of_elevation, *(F.when(absent(c), F.lit(n)) for c, n in (("uid", "uid"), ("name", "name"), ("field", "field"), ("time_zone", "timeZone"))))
    lacking = F.when(F.col("place").isNotNull(), F.filter(lacking, lambda x: x.isNotNull()))
    before = F.when(F.col("place") > 0, F.concat(F.lit("wells["), F.col("place").cast("string"), F.lit("]."))).otherwise("")
    rows = rows.withColumn("missing", F.transform(lacking, lambda x: F.concat(before, x)))
    first = F.when(F.col("place") == 0, F.size("missing") > 0)
    incomplete = rows.where(first).select("path").distinct().withColumn("__incomplete", F.lit(True))
    rows = rows.join(incomplete, "path", "left")
    reason = F.coalesce("reason", F.when(F.col("__incomplete"), "missing_fields"))
    status = (
        F.when(reason.isin("empty_file", "no_well_object"), "empty").when(reason == "not_well_formed", "corrupt_input").when(reason == "missing_fields", "incomplete")
        .when(reason.isNotNull(), "unsupported_version").otherwise("ok")
    )
    shown = F.when(reason.isNull() | reason.isin("missing_fields", "no_well_object"), "1.4.1.1").otherwise(F.col("version"))
    return rows.select(
        "path", status.alias("status"), reason.alias("reason"), shown.alias("version"), "place", "uid", "name", "field", "time_zone", "elevation",
        *(F.when(F.col("place").isNotNull(), F.col(c)).alias(c) for c in ("texts", "measures", "location")), "missing",
    )


def geojson(files: DataFrame, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, place, type, properties, lon, lat, wkt, west, east, south, north), (path, code)) of GeoJSON files (path, content).

    place counts a file's features from 0; properties maps names to text. A point has a position and its text form, a polygon
    the box of its outer ring; what does not apply is null. Codes: invalid (no JSON object with a list of features), geometry
    (a feature whose geometry is neither a point nor a polygon of finite positions within 180 and 90 degrees), count (another
    number of features than expected (path, n)), missing (expected, not there). Files with a problem give no features.
    """
    spark = files.sparkSession
    value = files.select("path", F.try_variant_get(F.try_parse_json(F.col("content").cast("string")), "$.features", "variant").alias("list"))
    listed = F.coalesce(F.schema_of_variant("list").startswith("ARRAY"), F.lit(False))
    problems = value.where(~listed).select("path", F.lit("invalid").alias("code"))
    every = spark.sql("SELECT path, CAST(e.pos AS LONG) AS place, e.value AS f FROM {held}, LATERAL variant_explode(list) e", held=value.where(listed))
    get = lambda p, t: F.try_variant_get("f", p, t)
    kind = get("$.geometry.type", "string")
    point = F.when(kind == "Point", get("$.geometry.coordinates", "array<double>"))
    ring = F.when(kind == "Polygon", get("$.geometry.coordinates[0]", "array<array<double>>"))
    rows = every.select("path", "place", kind.alias("type"), get("$.properties", "map<string,string>").alias("properties"), point.alias("point"), ring.alias("ring"))
    at = lambda p, k: F.get(p, F.lit(k))
    placed = lambda p: F.coalesce((F.size(p) >= 2) & (F.abs(at(p, 0)) <= 180) & (F.abs(at(p, 1)) <= 90), F.lit(False))
    sound = F.coalesce(placed(F.col("point")) | ((F.size("ring") > 0) & F.forall("ring", placed)), F.lit(False))
    faulty = rows.where(~sound).select("path", F.lit("geometry").alias("code")).distinct()
    problems = problems.unionByName(faulty)
    if expected is not None:
        counted = rows.groupBy("path").agg(F.count("*").alias("found"))
        due = expected.select("path", "n").join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").join(counted, "path", "left")
        due = due.join(problems.select("path"), "path", "left_anti").where("there is null or n <> coalesce(found, 0)")
        problems = problems.unionByName(due.select("path", F.when(F.col("there").isNull(), "missing").otherwise("count").alias("code")))
    lon, lat, axis = at(F.col("point"), 0), at(F.col("point"), 1), lambda k: F.transform("ring", lambda p: at(p, k))
    features = rows.join(problems.select("path").distinct(), "path", "left_anti").select(
        "path", "place", "type", "properties", lon.alias("lon"), lat.alias("lat"), F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")).alias("wkt"),
        F.array_min(axis(0)).alias("west"), F.array_max(axis(0)).alias("east"), F.array_min(axis(1)).alias("south"), F.array_max(axis(1)).alias("north"),
    )
    return features, problems
