"""The collection: built as a whole or not at all, and queried read-only."""

import hashlib
import json

import pytest

from quarrylake.operators import collection
from quarrylake.operators.collection import QueryRefused
from quarrylake.sources import publish
from quarrylake.sources.publish import Refused
from quarrylake.storage import scratch_path

FACTS = """kind string, id string, type_id string, properties string, source_entity_id string, source_type_id string, target_entity_id string, target_type_id string,
           subject_entity_id string, subject_type_id string, value string, unit string, conditions string, source_id string, fragment_id string"""


def fact(kind, i, **more):
    base = dict.fromkeys([c.split()[0] for c in FACTS.split(",")])
    return tuple((base | {"kind": kind, "id": i, "type_id": "t", "source_id": "source-a", "fragment_id": "fragment-a"} | more).values())


def facts(spark, *extra):
    rows = [
        fact("entity", "node:one", properties='{"label":"x","n":1,"deep":{"a":[1]}}'), fact("entity", "node:two", properties="{}"),
        fact("relation", "r1", source_entity_id="node:one", source_type_id="t", target_entity_id="node:two", target_type_id="t"),
        fact("observation", "o1", subject_entity_id="node:one", subject_type_id="t", value="1.5", unit="m", conditions="{}"),
    ]
    return spark.createDataFrame([*rows, *extra], FACTS)


def parts(spark):
    fragments = spark.createDataFrame([("fragment-a", "source-a", "line:1", "some text")], "fragment_id string, source_id string, locator string, text string")
    sources = spark.createDataFrame([("source-a", "a.txt", "text/plain")], "source_id string, filename string, content_type string")
    return fragments, sources, {"ontology_id": "demo", "schema_version": 1}


@pytest.fixture(scope="module")
def held(spark):
    path = scratch_path(spark, "collection")
    collection.build(spark, path, facts(spark), *parts(spark))
    return collection.Collection(spark, path)


def test_join_rows_and_source_refs(held):
    sql = """SELECT a.node_id AS source_node_id, b.node_id AS target_node_id, r.source_id, r.fragment_id
             FROM relations r JOIN nodes a ON a.node_id = r.source_node_id JOIN nodes b ON b.node_id = r.target_node_id"""
    found = held.query(sql, [], 20)
    assert found["rows"] == [{"source_node_id": "node:one", "target_node_id": "node:two", "source_id": "source-a", "fragment_id": "fragment-a"}]
    assert found["source_refs"] == [{"source_id": "source-a", "fragment_id": "fragment-a"}]
    empty = held.query("SELECT node_id, source_id, fragment_id FROM nodes WHERE 1 = 0")
    assert empty["columns"] == ["node_id", "source_id", "fragment_id"] and empty["rows"] == [] and not empty["truncated"] and empty["source_refs"] == []


@pytest.mark.parametrize(("most", "rows", "truncated"), [(3, 2, False), (2, 2, False), (1, 1, True)])
def test_row_cap(held, most, rows, truncated):
    found = held.query("SELECT node_id FROM nodes ORDER BY node_id", [], most)
    assert len(found["rows"]) == rows and found["truncated"] is truncated


@pytest.mark.parametrize("most", [0, -1, 201, True, 1.5, None])
def test_row_cap_is_checked(held, most):
    with pytest.raises(QueryRefused, match="INPUT_INVALID"):
        held.query("SELECT 1 AS one", [], most)


def test_parameters_are_values(held):
    assert held.query("WITH s AS (SELECT ? AS value) SELECT value FROM s", ["quote'; -- still data"])["rows"] == [{"value": "quote'; -- still data"}]
    for v in (-(2**63), 2**63 - 1, 0.5, None):
        assert held.query("SELECT ? AS value", [v])["rows"] == [{"value": v}]


@pytest.mark.parametrize("v", [float("nan"), float("inf"), 2**63, -(2**63) - 1, True, b"x", [1]])
def test_bad_parameters(held, v):
    with pytest.raises(QueryRefused, match="INPUT_INVALID"):
        held.sql("SELECT ? AS value", [v])


@pytest.mark.parametrize(
    "sql",
    [
        "DROP VIEW nodes", "INSERT INTO nodes SELECT * FROM nodes", "WITH a AS (SELECT 1 x) INSERT INTO nodes SELECT * FROM a", "CREATE TABLE t AS SELECT 1 x", "SET spark.sql.ansi.enabled=false",
        "CACHE TABLE nodes", "EXPLAIN SELECT 1", "SHOW TABLES", "DESCRIBE nodes", "USE default", "ADD JAR '/tmp/x.jar'", "BEGIN SELECT 1; END", "REFRESH TABLE nodes", "DELETE FROM nodes",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x", "SELECT try_reflect('java.lang.System', 'nanoTime') AS x", "SELECT java_method('java.lang.System', 'nanoTime') AS x",
        "SELECT input_file_name() AS f FROM nodes", "SELECT node_id FROM nodes WHERE node_id IN (SELECT reflect('java.lang.System', 'lineSeparator'))",
    ],
)
def test_denied(held, sql):
    with pytest.raises(QueryRefused, match="QUERY_DENIED"):
        held.sql(sql)


def test_files_and_foreign_tables_are_denied(spark, held):
    path = scratch_path(spark, "other")
    spark.range(3).write.parquet(path)
    for sql in (f"SELECT * FROM parquet.`{path}`", f"SELECT (SELECT max(id) FROM parquet.`{path}`) AS m", f"WITH a AS (SELECT * FROM parquet.`{path}`) SELECT node_id FROM nodes WHERE EXISTS (SELECT 1 FROM a)"):
        with pytest.raises(QueryRefused, match="QUERY_DENIED"):
            held.sql(sql)
    spark.range(3).createOrReplaceTempView("of_the_other_session")
    with pytest.raises(QueryRefused, match="QUERY_INVALID"):
        held.sql("SELECT * FROM of_the_other_session")


def test_bad_queries(held):
    for sql in ("SELEC 1", "SELECT nothing FROM nodes", "SELECT node_id, type_id AS node_id FROM nodes", "SELECT node_id AS a, type_id AS A FROM nodes", "SELECT array(1) AS x", "SELECT x'00' AS b", "SELECT ? AS a"):
        with pytest.raises(QueryRefused, match="QUERY_INVALID"):
            held.sql(sql)
    for sql in ("", "  ", None, 5, "SELECT 1\x00"):
        with pytest.raises(QueryRefused, match="INPUT_INVALID"):
            held.sql(sql)
    for sql in ("SELECT double('nan') AS x", "SELECT double('infinity') AS x", "SELECT raise_error('x') AS e"):
        with pytest.raises(QueryRefused, match="QUERY_INVALID"):
            held.query(sql)


def test_recursion_and_json_each(held):
    assert held.query("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT sum(n) AS s FROM t")["rows"] == [{"s": 15}]
    found = held.query("SELECT e.key, e.value, e.type FROM nodes n, LATERAL json_each(n.properties_json) e ORDER BY e.key")["rows"]
    assert [(r["key"], r["value"], r["type"]) for r in found] == [("deep", '{"a":[1]}', "object"), ("label", "x", "text"), ("n", "1", "integer")]
    sql = """SELECT (SELECT value FROM json_each('{"label": "x"}') WHERE type = 'text' LIMIT 1) AS label FROM nodes"""
    assert [r["label"] for r in held.query(sql)["rows"]] == ["x", "x"]


def test_long_values_and_slow_queries(held):
    assert held.query("SELECT repeat('a', 1024) AS v", max_value_bytes=1024)["rows"][0]["v"] == "a" * 1024
    with pytest.raises(QueryRefused, match="QUERY_VALUE_TOO_LARGE"):
        held.query("SELECT repeat('ä', 513) AS v", max_value_bytes=1024)
    with pytest.raises(QueryRefused, match="QUERY_BUDGET_EXCEEDED"):
        held.query("SELECT sum(hash(a.id, b.id)) AS s FROM range(1000000) a, range(1000000) b", seconds=2)
    assert held.query("SELECT 1 AS one")["rows"] == [{"one": 1}]


def test_result_document(spark, held):
    found = held.query("SELECT node_id, source_id, fragment_id FROM nodes ORDER BY node_id", [], 1)
    path = scratch_path(spark, "result")
    told = collection.write_result(spark, path, found)
    text = publish.read_text(spark, path)
    assert told == {"sha256": hashlib.sha256(text.encode()).hexdigest(), "size_bytes": len(text.encode())}
    assert json.loads(text) == {
        "collection_sha256": held.sha256, "sql": found["sql"], "parameters": [], "columns": ["node_id", "source_id", "fragment_id"], "truncated": True,
        "rows": [{"node_id": "node:one", "source_id": "source-a", "fragment_id": "fragment-a"}], "source_refs": [{"source_id": "source-a", "fragment_id": "fragment-a"}],
    }


def test_inspect(held):
    told = held.inspect()
    assert list(told["tables"]) == ["nodes", "relations", "observations", "fragments", "source_status"]
    assert told["counts"]["nodes"] == 2 and told["metadata"]["ontology_id"] == '"demo"'


BROKEN = [
    (fact("relation", "r2", source_entity_id="node:one", source_type_id="t", target_entity_id="node:nine", target_type_id="t"), "relations.target_node_id has no nodes.node_id"),
    (fact("entity", "node:one", properties="{}"), "key of nodes"),
    (fact("entity", "node:three", properties="{}", fragment_id="fragment-z"), "nodes.fragment_id has no fragments.fragment_id"),
    (fact("observation", "o2", subject_entity_id="node:one", subject_type_id="t", conditions="{}"), "observations.value_json is null"),
]


def test_broken_collections_are_not_published(spark):
    path = scratch_path(spark, "collection")
    first = collection.build(spark, path, facts(spark), *parts(spark))
    for extra, rule in BROKEN:
        with pytest.raises(Refused) as refused:
            collection.build(spark, path, facts(spark, extra), *parts(spark))
        assert [r for r, _ in refused.value.problems] == [rule]
    assert collection.build(spark, path, facts(spark), *parts(spark)) == first | {"unchanged": True}
    assert collection.Collection(spark, path).query("SELECT count(*) AS n FROM nodes")["rows"] == [{"n": 2}]
