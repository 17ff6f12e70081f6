"""Publication of sets of tables and files: written beside the published version, checked there, made current in one step."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quarrylake.sources.files import scan, verify

OWNER, SCHEMA_VERSION, MARKER = "quarrylake", 1, "CURRENT"


class Refused(ValueError):
    """A publication or load that did not take place; what was published before is still current.

    code: NOT_OWNED, FATAL_ISSUES, INVALID, COUNT_MISMATCH, CHECKSUM, EMPTY or CHANGED_MEANWHILE; problems: (rule, rows).
    """

    def __init__(self, code: str, problems: list[tuple[str, int]] | None = None):
        self.code, self.problems = code, problems or []
        super().__init__(f"{code}: " + ", ".join(f"{rule} ({n})" for rule, n in self.problems))


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(conf), at


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file in the shared store; None if there is none."""
    jvm, fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in the shared store: written beside it and renamed over it, so readers see the old text or the new."""
    jvm, fs, at = _hadoop(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, at, options)


def _delete(spark: SparkSession, path: str) -> None:
    _, fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def marker(spark: SparkSession, path: str) -> dict | None:
    """What is published at path; None if the place is empty. A place with other things in it is refused."""
    text = read_text(spark, f"{path}/{MARKER}")
    if text is None:
        _, fs, at = _hadoop(spark, path)
        others = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        if [n for n in others if n != "versions" and not n.startswith(MARKER)]:
            raise Refused("NOT_OWNED", [("files without a marker", len(others))])
        return None
    try:
        held = json.loads(text)
    except ValueError:
        held = None
    if not isinstance(held, dict) or held.get("owner") != OWNER or held.get("schema_version") != SCHEMA_VERSION:
        raise Refused("NOT_OWNED", [("marker of another owner or schema", 1)])
    return held


def _row_hash(df: DataFrame, seed: int) -> Column:
    whole = [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema]
    gaps = F.concat(F.lit(""), *(F.when(c.isNull(), "1").otherwise("0") for c in whole))
    return F.xxhash64(F.lit(seed), gaps, *whole).cast("decimal(38,0)")


def _content(df: DataFrame) -> list[Column]:
    """Aggregates that tell the rows of a table, whatever their order: their number and two sums of row hashes."""
    return [F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(_row_hash(df, s)), F.lit(0)).cast("string").alias(f"sum{s}") for s in (1, 2))]


def _together(jobs: list[Callable]) -> list:
    """Results of Spark jobs that are handed in at once: small tables leave most of a cluster idle otherwise."""
    with ThreadPoolExecutor(max(1, min(8, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def content_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table: equal rows in another order or partitioning have the same digest. Repeated rows count."""
    rows, one, two = df.agg(*_content(df)).first()
    return rows, hashlib.sha256(canonical_json([df.dtypes, rows, one, two]).encode()).hexdigest()


def violations(tables: dict[str, DataFrame], keys: dict[str, list[str]], foreign: Iterable[tuple[str, str, str, str]], required: dict[str, list[str]]) -> list[tuple[str, int]]:
    """(rule, rows) of the broken rules: keys that are null or repeat, references (table, column, parent, column) without a
    row in the parent, required columns that are null. A null reference points nowhere and is no violation."""

    def repeated(name: str, columns: list[str]) -> list:
        bad = (F.col("n") > 1) | F.expr(" or ".join(f"`{c}` is null" for c in columns))
        return [(f"key of {name}", tables[name].groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where(bad).count())]

    def empty(name: str, columns: list[str]) -> list:
        gaps = tables[name].agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
        return [(f"{name}.{c} is null", gaps[c]) for c in columns]

    def dangling(name: str, column: str, parent: str, to: str) -> list:
        ends = tables[name].where(F.col(column).isNotNull()).select(F.col(column).alias("end")).groupBy("end").count()
        n = ends.join(tables[parent].select(F.col(to).alias("end")), "end", "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        return [(f"{name}.{column} has no {parent}.{to}", n)]

    jobs = [partial(repeated, *k) for k in keys.items()] + [partial(empty, *r) for r in required.items()] + [partial(dangling, *f) for f in foreign]
    found = [rule for rules in _together(jobs) for rule in rules]
    return [(rule, n) for rule, n in found if n]


def publish(
    spark: SparkSession, path: str, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, foreign: Iterable[tuple[str, str, str, str]] = (),
    required: dict[str, list[str]] | None = None, issues: DataFrame | None = None, expected: dict[str, int] | None = None, metadata: dict | None = None,
) -> dict:
    """Publish tables together at path; returns the marker, with unchanged true if the same content was there already.

    Before anything is written, rows of issues whose column fatal is true refuse the load. The tables are written to a folder
    of their own, with their rows and content observed on the way; then rules are checked on what was written (violations()),
    the rows there must be those observed and, if given, those expected. Only then the marker is replaced, in one step. On
    any failure the folder is deleted and the version before stays current and readable. Content that equals the published
    one by digest, with all its rows still there, writes nothing. A place that holds anything else is refused.
    """
    before = marker(spark, path)
    if issues is not None and (fatal := issues.where("fatal").count()):
        raise Refused("FATAL_ISSUES", [("fatal issues", fatal)])
    contents = dict(zip(tables, _together([partial(content_digest, df) for df in tables.values()]), strict=True))
    digest = hashlib.sha256(canonical_json([contents, metadata or {}]).encode()).hexdigest()
    counts = {name: rows for name, (rows, _) in contents.items()}
    if before and before["digest"] == digest and _together([read(spark, path, name).count for name in counts]) == list(counts.values()):
        return before | {"unchanged": True}
    if expected and (off := [(f"rows of {name}", counts.get(name, 0)) for name, n in expected.items() if counts.get(name, 0) != n]):
        raise Refused("COUNT_MISMATCH", off)
    version = uuid.uuid4().hex
    staged = f"{path}/versions/{version}"

    def write(name: str, df: DataFrame) -> None:
        seen = Observation()
        df.observe(seen, *_content(df)).write.parquet(f"{staged}/{name}")
        got = seen.get
        written = spark.read.parquet(f"{staged}/{name}").count()
        again = hashlib.sha256(canonical_json([df.dtypes, got["rows"], got["sum1"], got["sum2"]]).encode()).hexdigest()
        if written != counts[name] or again != contents[name][1]:
            raise Refused("CHANGED_MEANWHILE", [(f"rows of {name}", written)])

    try:
        _together([partial(write, *t) for t in tables.items()])
        held = {name: spark.read.schema(df.schema).parquet(f"{staged}/{name}") for name, df in tables.items()}
        if broken := violations(held, keys or {}, foreign, required or {}):
            raise Refused("INVALID", broken)
        if marker(spark, path) != before:
            raise Refused("CHANGED_MEANWHILE", [("marker", 1)])
        new = {"owner": OWNER, "schema_version": SCHEMA_VERSION, "status": "complete", "version": version, "digest": digest, "counts": counts, "metadata": metadata or {}}
        write_text(spark, f"{path}/{MARKER}", canonical_json(new))
    except (Refused, PySparkException):
        _delete(spark, staged)
        raise
    return new | {"unchanged": False}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the version that is current now."""
    held = marker(spark, path)
    if held is None:
        raise Refused("EMPTY", [("published version", 0)])
    return spark.read.parquet(f"{path}/versions/{held['version']}/{name}")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the versions at path that are not current, left by later or broken publications; returns how many."""
    held, gone = marker(spark, path), 0
    _, fs, at = _hadoop(spark, f"{path}/versions")
    for status in fs.listStatus(at) if fs.exists(at) else []:
        if held is None or status.getPath().getName() != held["version"]:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone


def promote(spark: SparkSession, landed: str, pinned: DataFrame, path: str, pattern: str = "*") -> dict:
    """Make the landed files the current version at path if they are the pinned ones (name, bytes, sha256), else refuse.

    Checksums are computed where the files are; the folder is moved, not copied. No landed file, or no pinned one, is refused,
    and so are empty files, which a scan does not see, and files that do not fit pattern.
    """
    before = marker(spark, path)
    found = scan(spark, landed, pattern).drop("content")
    listed = pinned.select("name", "bytes", "sha256")
    if not pinned.head(1) or not found.head(1):
        raise Refused("EMPTY", [("files", 0)])
    bad = verify(found, listed).where("problem is not null").groupBy("problem").count().orderBy("problem").collect()
    _, fs, at = _hadoop(spark, landed)
    bad = [(r["problem"], r["count"]) for r in bad]
    if not bad and (more := fs.getContentSummary(at).getFileCount() - pinned.count()):
        bad = [("empty or of another name", more)]
    if bad:
        raise Refused("CHECKSUM", bad)
    rows, digest = content_digest(listed)
    if before and before["digest"] == digest:
        return before | {"unchanged": True}
    version = uuid.uuid4().hex
    jvm, fs, at = _hadoop(spark, f"{path}/versions/{version}")
    fs.mkdirs(at)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(landed), jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{version}/files")):
        raise Refused("CHANGED_MEANWHILE", [("landed files", rows)])
    new = {"owner": OWNER, "schema_version": SCHEMA_VERSION, "status": "complete", "version": version, "digest": digest, "counts": {"files": rows}, "metadata": {}}
    write_text(spark, f"{path}/{MARKER}", canonical_json(new))
    return new | {"unchanged": False}
