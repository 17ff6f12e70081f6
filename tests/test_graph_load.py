"""The graph from streams: any batches give the tables of one batch load, and a batch counts once."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylake.sources import publish
from quarrylake.storage import scratch_path
from quarrylake.streaming import graph_load

RAW = "id long, user string, kind string, friend string"


def nodes_of(df):
    return df.select(F.lit("User").alias("label"), F.col("user").alias("key"), F.create_map(F.lit("last"), F.col("kind"), F.concat(F.lit("did_"), F.coalesce("kind", F.lit("none"))), F.lit("yes")).alias("properties"), F.col("id").alias("at"))


def edges_of(df):
    return df.select(F.lit("KNOWS").alias("type"), F.col("user").alias("start_key"), F.col("friend").alias("end_key"))


def made_up(n, seed=1):
    rng = random.Random(seed)
    user = lambda: rng.choice([f"u{rng.randrange(n // 3)}", "hub", None if rng.random() < 0.05 else "hub"])
    return [(k, user(), rng.choice(["a", "b", None]), rng.choice([user(), f"x{rng.randrange(9)}"])) for k in range(n)]


def expected(rows):
    nodes, at = {}, {}
    for i, user, kind, _ in rows:
        if user is not None:
            held = nodes.setdefault(user, {})
            for name, value in (("last", kind), (f"did_{kind or 'none'}", "yes")):
                if value is not None and i >= at.get((user, name), -1):
                    held[name], at[user, name] = value, i
    edges = {(u, f) for _, u, _, f in rows if u is not None and f is not None}
    return nodes, {e for e in edges if e[1] in nodes}, {e for e in edges if e[1] not in nodes}


def seen(spark, path):
    nodes, edges, pending = graph_load.graph(spark, path)
    pairs = lambda df: {(r["start_key"], r["end_key"]) for r in df.collect()}
    held = nodes.collect()
    assert len(held) == len({r["key"] for r in held})
    return {r["key"]: r["properties"] for r in held}, pairs(edges), pairs(pending)


def test_batches_in_any_order_equal_one_load(spark):
    rows = made_up(300)
    path = scratch_path(spark, "graph")
    order = random.Random(2).sample(range(6), 6)
    for number, k in enumerate(order):
        batch = spark.createDataFrame(rows[k::6], RAW)
        assert graph_load.add(spark, path, nodes_of(batch), edges_of(batch), "s", number)
        if number == 3:
            assert graph_load.compact(spark, path) == 4
    assert seen(spark, path) == expected(rows)
    last = spark.createDataFrame([(k, "hub", "other", "x1") for k in range(900, 999)], RAW)
    before = publish.read_text(spark, f"{path}/CURRENT")
    assert not graph_load.add(spark, path, nodes_of(last), edges_of(last), "s", 5)  # a batch of that number was added
    assert publish.read_text(spark, f"{path}/CURRENT") == before and seen(spark, path) == expected(rows)
    assert graph_load.add(spark, path, nodes_of(last), edges_of(last), "other source", 5)
    assert seen(spark, path)[0]["hub"]["last"] == "other"


def test_a_batch_that_broke_off_is_not_seen(spark):
    path = scratch_path(spark, "graph")
    first = spark.createDataFrame([(1, "a", "k", "b"), (2, "b", "k", None)], RAW)
    graph_load.add(spark, path, nodes_of(first), edges_of(first), "s", 0)
    broken = edges_of(first).withColumn("type", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        graph_load.add(spark, path, nodes_of(spark.createDataFrame([(3, "c", "k", "a")], RAW)), broken, "s", 1)
    assert seen(spark, path) == ({"a": {"last": "k", "did_k": "yes"}, "b": {"last": "k", "did_k": "yes"}}, {("a", "b")}, set())
    again = spark.createDataFrame([(3, "c", "k", "a")], RAW)
    assert graph_load.add(spark, path, nodes_of(again), edges_of(again), "s", 1) and ("c", "a") in seen(spark, path)[1]


def test_stream_in_several_runs(spark):
    rows = made_up(200, 5)
    landed, path, marks = (scratch_path(spark, x) for x in ("landed", "graph", "marks"))

    def land(part):
        spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").parquet(landed)

    def run():
        stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(landed)
        graph_load.load(stream, nodes_of, edges_of, path, "events", marks).awaitTermination()

    for k in range(3):
        land(rows[k * 50 : k * 50 + 50])
    run()
    assert seen(spark, path) == expected(rows[:150])
    run()  # nothing new
    land(rows[150:])
    run()
    assert seen(spark, path) == expected(rows)
    state = graph_load._state(spark, path)
    assert state["last"] == {"events": 3} and len(state["parts"]) == 4


def test_empty_graph_and_foreign_marker(spark):
    path = scratch_path(spark, "graph")
    assert seen(spark, path) == ({}, set(), set())
    publish.write_text(spark, f"{path}/CURRENT", '{"owner":"someone"}')
    with pytest.raises(publish.Refused, match="NOT_OWNED"):
        graph_load.graph(spark, path)
