"""A collection of facts with their evidence: built and published as six tables, inspected, and queried read-only by SQL."""

from __future__ import annotations

import datetime
import hashlib
import math
import threading
from collections.abc import Iterator

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType, VariantType

from quarrylake.sources import publish

#: The tables of a collection and their columns.
TABLES = {
    "nodes": ["node_id", "type_id", "properties_json", "source_id", "fragment_id"],
    "relations": ["relation_id", "type_id", "source_node_id", "source_type_id", "target_node_id", "target_type_id", "source_id", "fragment_id"],
    "observations": ["observation_id", "type_id", "subject_node_id", "subject_type_id", "value_json", "unit", "conditions_json", "source_id", "fragment_id"],
    "fragments": ["fragment_id", "source_id", "locator", "text"],
    "source_status": ["source_id", "filename", "content_type", "status"],
}
METADATA = "metadata"
KEYS = {"nodes": ["node_id"], "relations": ["relation_id"], "observations": ["observation_id"], "fragments": ["fragment_id"], "source_status": ["source_id"], METADATA: ["key"]}
FOREIGN = [
    ("fragments", "source_id", "source_status", "source_id"),
    *((t, "source_id", "source_status", "source_id") for t in ("nodes", "relations", "observations")),
    *((t, "fragment_id", "fragments", "fragment_id") for t in ("nodes", "relations", "observations")),
    ("relations", "source_node_id", "nodes", "node_id"),
    ("relations", "target_node_id", "nodes", "node_id"),
    ("observations", "subject_node_id", "nodes", "node_id"),
]
#: Columns that may be null.
OPTIONAL = {"unit"}
MAX_ROWS, MAX_VALUE_BYTES, SECONDS = 200, 1 << 20, 300.0
INT64 = 1 << 63

#: Expressions that run code of their own or look outside the collection.
DENIED_EXPRESSIONS = ("CallMethodViaReflection", "TryReflect", "InputFile", "PythonUDF", "PythonUDAF", "ScalaUDF", "ScalaUDAF", "ScalaAggregator", "HiveSimpleUDF", "HiveGenericUDF", "ApplyFunctionExpression", "V2Aggregator")
LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"

JSON_EACH = """
CREATE OR REPLACE TEMPORARY FUNCTION json_each(document STRING)
RETURNS TABLE (key STRING, value STRING, type STRING)
RETURN SELECT coalesce(key, CAST(pos AS STRING)), CAST(value AS STRING),
  CASE WHEN kind = 'VOID' THEN 'null' WHEN kind = 'STRING' THEN 'text' WHEN kind = 'BIGINT' THEN 'integer'
       WHEN kind = 'BOOLEAN' THEN CAST(value AS STRING) WHEN kind LIKE 'ARRAY%' THEN 'array' WHEN kind LIKE 'OBJECT%' THEN 'object' ELSE 'real' END
FROM (SELECT key, pos, value, schema_of_variant(value) AS kind FROM variant_explode(parse_json(document)))
"""


class QueryRefused(ValueError):
    """code: INPUT_INVALID, QUERY_DENIED, QUERY_INVALID, QUERY_VALUE_TOO_LARGE or QUERY_BUDGET_EXCEEDED."""

    def __init__(self, code: str, message: str):
        self.code = code
        super().__init__(f"{code}: {message}")


def tables_of(facts: DataFrame, fragments: DataFrame, sources: DataFrame, metadata: dict[str, object]) -> dict[str, DataFrame]:
    """The six tables of a collection.

    facts has one row for each fact: kind (entity, relation or observation), id, type_id, properties, source_entity_id,
    source_type_id, target_entity_id, target_type_id, subject_entity_id, subject_type_id, value, unit, conditions, source_id,
    fragment_id; properties, value and conditions are JSON text. Other columns are left out. metadata values become JSON.
    """
    of = lambda kind: facts.where(F.col("kind") == kind)
    rename = lambda df, old, new: df.select(*(F.col(o).cast("string").alias(n) for o, n in zip(old, new, strict=True)))
    evidence = ["source_id", "fragment_id"]
    pairs = [(k, publish.canonical_json(v)) for k, v in sorted(metadata.items())]
    return {
        "nodes": rename(of("entity"), ["id", "type_id", "properties", *evidence], TABLES["nodes"]),
        "relations": rename(of("relation"), ["id", "type_id", "source_entity_id", "source_type_id", "target_entity_id", "target_type_id", *evidence], TABLES["relations"]),
        "observations": rename(of("observation"), ["id", "type_id", "subject_entity_id", "subject_type_id", "value", "unit", "conditions", *evidence], TABLES["observations"]),
        "fragments": rename(fragments, TABLES["fragments"], TABLES["fragments"]),
        "source_status": rename(sources.withColumn("status", F.lit("indexed")), TABLES["source_status"], TABLES["source_status"]),
        METADATA: facts.sparkSession.createDataFrame(pairs, "key string, value_json string"),
    }


def build(spark: SparkSession, path: str, facts: DataFrame, fragments: DataFrame, sources: DataFrame, metadata: dict[str, object]) -> dict:
    """Publish a collection at path: all tables or none, ids unique, every reference resolved, no empty column but unit.

    Same inputs again change nothing; see publish.publish() for what happens on failure.
    """
    required = {name: [c for c in columns if c not in OPTIONAL] for name, columns in TABLES.items()}
    return publish.publish(spark, path, tables_of(facts, fragments, sources, metadata), KEYS, FOREIGN, required)


def parameters_of(values: object) -> list:
    """Checked positional parameters: texts, finite numbers, integers of 64 bits, nulls."""
    if values is None:
        return []
    if not isinstance(values, list):
        raise QueryRefused("INPUT_INVALID", "parameters must be a list")
    for v in values:
        sound = v is None or isinstance(v, str) or (isinstance(v, int) and not isinstance(v, bool) and -INT64 <= v < INT64) or (isinstance(v, float) and math.isfinite(v))
        if not sound:
            raise QueryRefused("INPUT_INVALID", "a parameter is no text, finite number, 64-bit integer or null")
    return values


def _each(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


class Collection:
    """The published collection at a path, in a session of its own: nothing but its tables can be named in a query."""

    def __init__(self, spark: SparkSession, path: str):
        held = publish.marker(spark, path)
        if held is None:
            raise publish.Refused("EMPTY", [("published collection", 0)])
        self.sha256, self.counts = held["digest"], {t: held["counts"][t] for t in TABLES}
        self.session = spark.newSession()
        for setting in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            self.session.conf.set(setting, spark.conf.get(setting))
        for name in (*TABLES, METADATA):
            self.session.read.parquet(f"{path}/versions/{held['version']}/{name}").createOrReplaceTempView(name)
        self.session.sql(JSON_EACH)

    def inspect(self) -> dict:
        """Tables with their columns and rows, and the collection's metadata."""
        kept = {r["key"]: r["value_json"] for r in self.session.table(METADATA).collect()}
        return {"tables": TABLES, "counts": self.counts, "collection_sha256": self.sha256, "metadata": kept}

    def _parse(self, text: str) -> None:
        """Refuses all statements but queries before Spark looks at what they name: commands run at once."""
        try:
            plan = self.session._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except Py4JJavaError as error:
            raise QueryRefused("QUERY_INVALID", str(error.java_exception.getMessage()).split("\n")[0]) from None
        except PySparkException as error:
            raise QueryRefused("QUERY_INVALID", str(error).strip().split("\n")[0]) from None
        gateway = self.session.sparkContext._gateway
        todo = [plan]
        while todo:
            node = todo.pop()
            if any(is_instance_of(gateway, node, f"{LOGICAL}.{c}") for c in ("Command", "ParsedStatement", "CompoundPlanStatement")):
                raise QueryRefused("QUERY_DENIED", "only queries are allowed")
            todo += [*_each(node.children()), *_each(node.innerChildren())]

    def _inspect_plan(self, df: DataFrame) -> None:
        """Refuses plans that read anything but the collection's views or call code from outside."""
        todo = [df._jdf.queryExecution().analyzed()]
        while todo:
            node = todo.pop()
            name = node.getClass().getSimpleName()
            if name == "View" and node.desc().identifier().table() in (*TABLES, METADATA) and node.isTempView():
                continue
            children = list(_each(node.children()))
            if not children and not name.startswith(("OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef", "Range", "EmptyRelation")):
                raise QueryRefused("QUERY_DENIED", f"{name} is no table of the collection")
            if name.startswith(("ScriptTransformation", "MapIn", "FlatMap", "PythonMapIn")):
                raise QueryRefused("QUERY_DENIED", f"{name} runs code from outside")
            todo += children
            expressions = list(_each(node.expressions()))
            while expressions:
                e = expressions.pop()
                kind = e.getClass().getSimpleName()
                if kind.startswith(DENIED_EXPRESSIONS):
                    raise QueryRefused("QUERY_DENIED", f"{kind} is not allowed")
                if is_instance_of(self.session.sparkContext._gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
                    todo.append(e.plan())
                expressions += list(_each(e.children()))

    def sql(self, text: object, parameters: object = None) -> DataFrame:
        """The rows of one query, with ? for the parameters: selects, joins, common tables, recursion, functions and
        json_each(document), which gives (key, value, type) as texts. Not run yet.

        Statements that write, define, set, cache or explain, other tables, files and foreign code are refused, and so are
        repeated column names and columns of bytes, lists, maps or structs.
        """
        values = parameters_of(parameters)
        if not isinstance(text, str) or not text.strip() or "\x00" in text:
            raise QueryRefused("INPUT_INVALID", "the query must be text")
        self._parse(text)
        try:
            df = self.session.sql(text, args=values)
            columns, types = df.columns, [f.dataType for f in df.schema]
        except PySparkException as error:
            raise QueryRefused("QUERY_INVALID", str(error).strip().split("\n")[0]) from None
        self._inspect_plan(df)
        if len({c.lower() for c in columns}) != len(columns):
            raise QueryRefused("QUERY_INVALID", "the result has duplicate column labels")
        if any(isinstance(t, (BinaryType, ArrayType, MapType, StructType, VariantType)) for t in types):
            raise QueryRefused("QUERY_INVALID", "the result has unsupported values")
        return df

    def query(self, text: object, parameters: object = None, max_rows: int = MAX_ROWS, max_value_bytes: int = MAX_VALUE_BYTES, seconds: float = SECONDS) -> dict:
        """The result document of a query: columns, at most max_rows rows, truncated if there are more, the sources that rows
        name, and what was asked. One row more than asked for is computed; a value that is too long never leaves its task,
        and jobs that run longer than seconds are cancelled."""
        if isinstance(max_rows, bool) or not isinstance(max_rows, int) or not 1 <= max_rows <= MAX_ROWS:
            raise QueryRefused("INPUT_INVALID", f"max_rows must be between 1 and {MAX_ROWS}")
        df = self.sql(text, parameters)
        kept, long = [], F.lit(False)
        for name, kind in df.dtypes:
            c = F.col(f"`{name}`")
            if kind.startswith(("string", "char", "varchar")):
                fits = F.octet_length(c) <= max_value_bytes
                long = long | F.coalesce(~fits, F.lit(False))
                c = F.when(fits, c).alias(name)
            kept.append(c)
        bounded = df.limit(max_rows + 1).select(*kept, long.alias("__too_long"))
        rows = self._within(bounded, seconds)
        if any(r["__too_long"] for r in rows):
            raise QueryRefused("QUERY_VALUE_TOO_LARGE", "a value exceeds the limit")
        found = [{c: _plain(r[c]) for c in df.columns} for r in rows[:max_rows]]
        document = {
            "collection_sha256": self.sha256, "sql": text, "parameters": parameters_of(parameters), "columns": df.columns,
            "rows": found, "truncated": len(rows) > max_rows, "source_refs": source_refs(df.columns, found),
        }
        return document

    def _within(self, df: DataFrame, seconds: float) -> list:
        context, tag, over = self.session.sparkContext, f"collection-{id(df)}", threading.Event()

        def stop() -> None:
            over.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            return df.collect()
        except (PySparkException, Py4JJavaError) as error:
            if over.is_set():
                raise QueryRefused("QUERY_BUDGET_EXCEEDED", f"the query ran longer than {seconds} s") from None
            raise QueryRefused("QUERY_INVALID", str(error).strip().split("\n")[0]) from None
        finally:
            timer.cancel()
            context.removeJobTag(tag)


def _plain(value: object) -> object:
    """A result value as JSON has it: days and times in ISO form, exact numbers as integers where they are whole."""
    if isinstance(value, float) and not math.isfinite(value):
        raise QueryRefused("QUERY_INVALID", "the result has unsupported values")
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    try:
        return int(value) if value == int(value) else float(value)
    except (TypeError, ValueError, OverflowError):
        raise QueryRefused("QUERY_INVALID", "the result has unsupported values") from None


def source_refs(columns: list[str], rows: list[dict]) -> list[dict]:
    """The different (source_id, fragment_id) of the rows, sorted; none unless the result has both columns."""
    if "source_id" not in columns or "fragment_id" not in columns:
        return []
    pairs = {(r["source_id"], r["fragment_id"]) for r in rows if isinstance(r["source_id"], str) and isinstance(r["fragment_id"], str)}
    return [{"source_id": s, "fragment_id": f} for s, f in sorted(pairs)]


def write_result(spark: SparkSession, path: str, document: dict) -> dict:
    """Write a result document as canonical JSON; (sha256, size_bytes) of what was written."""
    text = publish.canonical_json(document)
    publish.write_text(spark, path, text)
    data = text.encode("utf-8")
    return {"sha256": hashlib.sha256(data).hexdigest(), "size_bytes": len(data)}
