"""Publication: staged, checked, committed in one step, and refused without a trace."""

import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarrylake.sources import publish
from quarrylake.sources.publish import Refused
from quarrylake.storage import scratch_path

KEYS, FOREIGN = {"nodes": ["key"]}, [("edges", "start", "nodes", "key"), ("edges", "end", "nodes", "key")]


def graph(spark, n, edges=None):
    nodes = spark.createDataFrame([(f"n{k}", {"a": str(k), "b": "x"}, None) for k in range(n)], "key string, properties map<string,string>, note string")
    return {"nodes": nodes, "edges": spark.createDataFrame(edges if edges is not None else [(f"n{k}", f"n{k + 1}") for k in range(n - 1)], "start string, end string")}


def test_publish_unchanged_and_replaced(spark):
    path = scratch_path(spark, "pub")
    first = publish.publish(spark, path, graph(spark, 5), KEYS, FOREIGN, expected={"nodes": 5, "edges": 4})
    assert not first["unchanged"] and first["counts"] == {"nodes": 5, "edges": 4}
    shuffled = {k: df.repartition(3).orderBy(F.rand(1)) for k, df in graph(spark, 5).items()}
    again = publish.publish(spark, path, shuffled, KEYS, FOREIGN)
    assert again["unchanged"] and again["version"] == first["version"]
    changed = publish.publish(spark, path, graph(spark, 6), KEYS, FOREIGN)
    assert not changed["unchanged"] and publish.read(spark, path, "nodes").count() == 6
    assert publish.vacuum(spark, path) == 1 and publish.read(spark, path, "nodes").count() == 6


@pytest.mark.parametrize(
    ("tables", "code", "rule"),
    [
        (lambda s: graph(s, 3, [("n0", "n9"), ("n1", "n9"), (None, "n1")]), "INVALID", ("edges.end has no nodes.key", 2)),
        (lambda s: graph(s, 3) | {"nodes": graph(s, 3)["nodes"].union(graph(s, 1)["nodes"])}, "INVALID", ("key of nodes", 1)),
        (lambda s: graph(s, 3) | {"nodes": graph(s, 3)["nodes"].union(s.createDataFrame([(None, None, None)], graph(s, 1)["nodes"].schema))}, "INVALID", ("key of nodes", 1)),
    ],
)
def test_invalid_load_leaves_the_old_version(spark, tables, code, rule):
    path = scratch_path(spark, "pub")
    old = publish.publish(spark, path, graph(spark, 5), KEYS, FOREIGN)
    with pytest.raises(Refused) as refused:
        publish.publish(spark, path, tables(spark), KEYS, FOREIGN)
    assert refused.value.code == code and rule in refused.value.problems
    assert publish.marker(spark, path)["version"] == old["version"] and publish.read(spark, path, "nodes").count() == 5
    assert publish.vacuum(spark, path) == 0  # nothing staged is left


def test_interrupted_load_leaves_the_old_version(spark):
    path = scratch_path(spark, "pub")
    publish.publish(spark, path, graph(spark, 5), KEYS, FOREIGN)
    broken = graph(spark, 7)
    flag = F.when(F.col("end") == "n6", F.raise_error(F.lit("lost"))).otherwise(F.col("end"))
    with pytest.raises(PySparkException):
        publish.publish(spark, path, broken | {"edges": broken["edges"].withColumn("end", flag)}, KEYS, FOREIGN)
    assert publish.read(spark, path, "edges").count() == 4 and publish.vacuum(spark, path) == 0


def test_preconditions_and_ownership(spark):
    path = scratch_path(spark, "pub")
    issues = spark.createDataFrame([("a", False), ("b", True)], "source string, fatal boolean")
    with pytest.raises(Refused, match="FATAL_ISSUES"):
        publish.publish(spark, path, graph(spark, 3), issues=issues)
    assert publish.marker(spark, path) is None
    with pytest.raises(Refused, match="COUNT_MISMATCH"):
        publish.publish(spark, path, graph(spark, 3), expected={"nodes": 4})
    assert not publish.publish(spark, path, graph(spark, 3), issues=issues.where("not fatal"))["unchanged"]
    spark.range(3).write.parquet(f"{path}x/data")
    with pytest.raises(Refused, match="NOT_OWNED"):
        publish.publish(spark, f"{path}x", graph(spark, 3))
    publish.write_text(spark, f"{path}x/CURRENT", '{"owner":"someone"}')
    with pytest.raises(Refused, match="NOT_OWNED"):
        publish.publish(spark, f"{path}x", graph(spark, 3))
    with pytest.raises(Refused, match="EMPTY"):
        publish.read(spark, f"{path}y", "nodes")


def test_digest_tells_content_not_order(spark):
    rows = [(1, None, {"a": "1", "b": "2"}), (None, 1, {"b": "2", "a": "1"}), (1, None, {"a": "1", "b": "2"})]
    df = spark.createDataFrame(rows, "a int, b int, m map<string,string>")
    assert publish.content_digest(df) == publish.content_digest(df.repartition(5).orderBy(F.desc("b")))
    assert publish.content_digest(df)[1] != publish.content_digest(spark.createDataFrame(rows[:2], df.schema))[1]
    swapped = spark.createDataFrame([(None, 1, {"a": "1", "b": "2"})] + rows[1:], df.schema)
    assert publish.content_digest(df)[1] != publish.content_digest(swapped)[1]
    assert publish.content_digest(df.where("false"))[0] == 0


def test_promote_verifies_landed_files(spark, tmp_path):
    def land(name, files):
        os.makedirs(tmp_path / name)
        for f, text in files.items():
            (tmp_path / name / f).write_bytes(text)
        return str(tmp_path / name)

    good = {"a.txt": b"one", "b.txt": b"two"}
    pin = spark.createDataFrame([(f, len(t), hashlib.sha256(t).hexdigest()) for f, t in good.items()], "name string, bytes long, sha256 string")
    path = str(tmp_path / "published")
    with pytest.raises(Refused) as refused:
        publish.promote(spark, land("bad", {"a.txt": b"one", "b.txt": b"twX", "c.txt": b"three"}), pin, path)
    assert refused.value.problems == [("checksum", 1), ("unexpected", 1)] and publish.marker(spark, path) is None
    assert sorted(os.listdir(tmp_path / "bad")) == ["a.txt", "b.txt", "c.txt"]
    with pytest.raises(Refused, match="empty"):
        publish.promote(spark, land("more", good | {"c.txt": b""}), pin, path)
    done = publish.promote(spark, land("ok", good), pin, path)
    assert done["counts"] == {"files": 2} and sorted(os.listdir(f"{path}/versions/{done['version']}/files")) == ["a.txt", "b.txt"]
    assert publish.promote(spark, land("again", good), pin, path)["unchanged"]
    with pytest.raises(Refused, match="EMPTY"):
        publish.promote(spark, land("none", {}), pin, path)
