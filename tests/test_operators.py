"""Small fixtures with the edge cases of the operators."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrylake.operators import graph, news, production, search, tabular, text, vectors
from quarrylake.operators.components import connected_components
from quarrylake.sources import files, sinks
from quarrylake.streaming import telemetry


def test_components_of_chain_loops_and_nulls(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 200)], "u long, v long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_endpoints_and_upsert(spark):
    nodes = spark.createDataFrame([("Well", "w1"), ("Wellbore", "b1"), ("Wellbore", "b2")], "label string, key string")
    edges = spark.createDataFrame([("OF", "b1", "w1"), ("OF", "b2", "w9"), ("OF", "x", "w1"), ("OF", "b1", "b2")], "type string, start_key string, end_key string")
    good, issues = graph.resolve_edges(edges, nodes, "Wellbore", "Well")
    assert [tuple(r) for r in good.collect()] == [("OF", "b1", "w1")]
    assert {r["start_key"] + r["end_key"]: r["reason"] for r in issues.collect()} == {"b2w9": "dangling_end", "xw1": "dangling_start", "b1b2": "wrong_label"}
    old = spark.createDataFrame([("Well", "w1", {"a": "1", "b": "2"}), ("Well", "w2", {})], "label string, key string, properties map<string,string>")
    new = spark.createDataFrame([("Well", "w1", {"b": "3"}), ("Well", "w3", {"c": "4"})], "label string, key string, properties map<string,string>")
    once = graph.upsert_nodes(old, new)
    assert {r["key"]: (r["outcome"], r["properties"]) for r in once.collect()} == {"w1": ("matched", {"a": "1", "b": "3"}), "w2": ("kept", {}), "w3": ("created", {"c": "4"})}
    assert graph.upsert_nodes(once.drop("outcome"), new).where("outcome = 'created'").count() == 0


def test_ids(spark):
    df = spark.createDataFrame([(" p:master-data--Well:a%2Fb: ",), ("a+b",), ("bad%zz",), (None,)], "id string")
    assert [r[0] for r in df.select(graph.normalize_id(F.col("id"))).collect()] == ["p:master-data--Well:a/b", "a+b", "bad%zz", None]


def test_numbers_and_periods(spark):
    df = spark.createDataFrame([("0",), (" -1.5 ",), ("NULL",), (" ",), (None,), ("1d",), ("nan",), ("1e999",)], "t string")
    assert [r[0] for r in df.select(production.number(F.col("t"))).collect()] == [0.0, -1.5, None, None, None, None, None, None]
    assert [r[0] for r in df.select(production.number_problem(F.col("t"))).collect()] == [False] * 5 + [True] * 3
    months = spark.createDataFrame([(1, 2016, 2), (1, 2016, 13)], "e int, y int, m int")
    got = production.monthly(months, F.col("e"), F.col("y"), F.col("m"), {}).collect()
    assert [(r["uid"], str(r["period_start"]), str(r["period_end"])) for r in got] == [("urn:production:monthly:1:2016-02", "2016-02-01", "2016-03-01")]
    assert str(spark.range(1).select(production.excel_day(F.lit(42_000))).first()[0]) == "2014-12-27"


def test_tables(spark):
    cells = spark.createDataFrame([("=cmd",), ("\n=cmd",), ("-5",), ("-x",), ("plain",), ("1e5",), (None,)], "c string")
    assert [r[0] for r in cells.select(tabular.guard_cell(F.col("c"))).collect()] == ["'=cmd", "'\n=cmd", "-5", "'-x", "plain", "1e5", None]
    levels = spark.createDataFrame([([1, 2, 4],), ([2, 3],), ([1, 1],), ([],)], "l array<int>")
    assert [r[0] for r in levels.select(tabular.levels_valid(F.col("l"))).collect()] == [True, False, False, True]


def test_nearest_blocks_agree(spark):
    e = spark.createDataFrame([(k, [float(k % 7 - 3), float(k % 5 - 2), 1.0]) for k in range(60)], "id long, vector array<double>").withColumn("vector", vectors.normalize(F.col("vector")))
    asked = e.where("id % 6 = 0").select(F.col("id").alias("query_id"), "vector")
    one = {tuple(r) for r in vectors.nearest(asked, e, 3).select("query_id", "id", "rank").collect()}
    assert one == {tuple(r) for r in vectors.nearest(asked, e, 3, block_rows=4).select("query_id", "id", "rank").collect()} and len(one) == 30
    with pytest.raises(ValueError):
        vectors.nearest(asked, e, 11)


def test_search(spark):
    docs = spark.createDataFrame([(1, "Oil well oil"), (2, "gas"), (3, None), (4, "well head")], "id long, t string")
    got = [(r["id"], r["score"] < 0) for r in search.bm25(docs, "oil well", "id", "t", 20).collect()]
    assert got == [(1, True), (4, True)]
    assert search.bm25(docs.limit(0), "oil", "id", "t", 5).count() == 0


def test_news(spark):
    urls = spark.createDataFrame([("HTTPS://A.Example.org/P?q=1#f",), ("x",)], "u string")
    assert [r[0] for r in urls.select(news.canonical_url(F.col("u"))).collect()] == ["https://a.example.org/P?q=1", "x"]
    rec = spark.createDataFrame([(1, "a"), (2, "a"), (3, " "), (4, " "), (5, "b")], "id long, k string")
    assert {tuple(r) for r in news.duplicate_groups(rec, "id", {"k": F.col("k")}).collect()} == {(1, 1), (2, 1)}
    due, got = spark.createDataFrame([(1,), (2,), (3,)], "d long"), spark.createDataFrame([(1,), (2,), (2,), (9,)], "d long")
    assert {tuple(r) for r in news.completeness(due, got, "d").collect()} == {(2, "repeated"), (3, "missing"), (9, "unexpected")}


def test_text(spark):
    df = spark.createDataFrame([("  <!-- image -->a\n\n\n\nb ",)], "t string")
    assert df.select(text.clean_markdown(F.col("t"))).first()[0] == "a\n\nb"
    chunks = spark.createDataFrame([("abcde",), ("",)], "t string").select(text.chunks(F.col("t"), 2)).collect()
    assert [r[0] for r in chunks] == [["ab", "cd", "e"], []]


def test_file_sources(spark, tmp_path):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>head</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5.0</v></c></row><row><c><v>1.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(book.getvalue())
    (tmp_path / "b.csv").write_bytes('﻿id;name\n1;"x\ny"\n'.encode())
    (tmp_path / "c.csv").write_bytes("id,name\n2,имя\n".encode("cp1251"))
    (tmp_path / "d.segy").write_bytes(b"x" * 10)
    (tmp_path / "e.json").write_text('{"kind": "k", "id": "1", "data": {"a": "b"}}')
    (tmp_path / "f.json").write_text("{broken")
    scan = lambda p: files.scan(spark, str(tmp_path), p)
    assert [r["cells"] for r in files.worksheet(scan("*.xlsx")).orderBy("row").collect()] == [["head", None, "5"], ["1.5"]]
    assert {(r["encoding"], r["delimiter"], tuple(r["cells"])) for r in files.delimited(scan("*.csv")).collect()} == {("utf-8", ";", ("1", "x\ny")), ("cp1251", ",", ("2", "имя"))}
    assert files.segy_headers(scan("*.segy")).first()["status"] == "truncated"
    assert {r["id"] for r in files.manifest_records(scan("*.json")).collect()} == {"1", None}
    listed = scan("*.csv").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "bytes", F.lit("0").alias("sha256")).limit(1)
    assert sorted(r["problem"] for r in files.verify(scan("*.csv"), listed).collect()) == ["checksum", "unexpected"]


@pytest.fixture
def plain_ranges(spark):
    """Ranges stay apart: adaptive execution would join such small ones."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_links_of_a_frequent_key_cross_ranges(spark, plain_ranges):
    rec = spark.range(200).selectExpr("id", "case when id % 50 = 7 then ' ' when id % 50 = 8 then null when id % 4 = 0 then 'rare' || id % 8 else 'hot' end k")
    by_key, expected = {}, set()
    for r in rec.orderBy("id").collect():
        if (r["k"] or "").strip():
            if r["k"] in by_key:
                expected.add(("k", by_key[r["k"]], r["id"]))
            by_key[r["k"]] = r["id"]
    found = [tuple(r) for r in news.duplicate_links(rec, "id", {"k": F.col("k")}).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert news.duplicate_links(rec.limit(0), "id", {"k": F.col("k")}).count() == 0


def test_codes_over_ranges(spark, plain_ranges):
    names = spark.range(300).selectExpr("case when id % 9 = 0 then null else 'n' || id % 40 end n")
    got = {r["n"]: r["code"] for r in tabular.codes(names, "n", "code").collect()}
    assert got == {n: k for k, n in enumerate(sorted(f"n{i}" for i in range(40)), 1)}
    assert tabular.codes(names.limit(0), "n", "code").count() == 0


def test_first_and_later_rows(spark):
    rows = spark.createDataFrame([("a ", 1), ("a", 3), (None, 2), (None, 5), ("b", 4)], "k string, n int")
    assert {r["n"] for r in tabular.mark_later(rows, "k", "n", "later").where("later").collect()} == {3, 5}
    first, report = graph.first_wins(rows, ["k"], ["n"], ["n"])
    assert {tuple(r) for r in first.collect()} == {("a ", 1), ("a", 3), (None, 2), ("b", 4)}
    assert {tuple(r) for r in report.collect()} == {("a ", 1, 0, False), ("a", 1, 0, False), (None, 2, 1, True), ("b", 1, 0, False)}


def test_nearest_within_and_in_waves(spark):
    e = spark.createDataFrame([(k, [float(k % 7 - 3), float(k % 5 - 2), 1.0], k % 3) for k in range(60)], "id long, vector array<double>, g int").withColumn("vector", vectors.normalize(F.col("vector")))
    asked = e.where("id % 2 = 0").select(F.col("id").alias("query_id"), "vector", "g")
    held = {tuple(r) for r in vectors.nearest(asked, e, 3, within="g").select("query_id", "id", "rank").collect()}
    assert len(held) == 90 and all(q % 3 == i % 3 for q, i, _ in held)
    assert held == {tuple(r) for r in vectors.nearest(asked, e, 3, block_rows=1, within="g").select("query_id", "id", "rank").collect()}


def test_stream_without_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    assert telemetry.run_available(stream, "append", "nothing").count() == 0
    assert telemetry.run_available(stream.groupBy("id").count(), "complete", "nothing").count() == 0


def test_quarantine(spark, tmp_path):
    points = "tag string, measured_at timestamp, value double, unit string"
    spark.sql("select 'a' tag, timestamp'2024-01-01' measured_at, 0d value, 'bar' unit union all select 'b', null, null, 'bar' union all select 'c', timestamp'2024-01-01', 1d, null").write.parquet(str(tmp_path / "in"))
    query = telemetry.split_by_status(spark.readStream.schema(points).parquet(str(tmp_path / "in")), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "marks"))
    query.awaitTermination()
    assert [r["tag"] for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["a"]
    assert {(r["tag"], *r["missing_fields"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {("b", "measured_at"), ("c", "unit")}


def test_parent_cycles(spark):
    rows = [(k, k - 1 if k else None) for k in range(20)] + [(100, 102), (101, 100), (102, 101), (103, 102), (200, 200), (300, 999), (None, 1)]
    parents = spark.createDataFrame(rows, "key int, parent int")
    assert {r["key"] for r in graph.parent_cycles(parents).collect()} == {100, 101, 102, 103, 200}
    assert graph.parent_cycles(parents.limit(0)).count() == 0


def test_search_form(spark):
    df = spark.createDataFrame([("ﬁn  Ё STRASSE ß",), ("",), (None,), ("é",)], "t string")
    assert [r[0] for r in df.select(text.search_form(F.col("t"))).collect()] == ["fin е strasse ss", "", None, "é"]


def test_written_forms(spark, tmp_path):
    odd = spark.createDataFrame([(1, "a<&>b", None), (2, None, 2.5), (3, " ", 1.0)], "id int, t string, x double")
    back = [r["cells"] for r in files.worksheet(sinks.workbooks(odd.coalesce(1))).orderBy("row").collect()]
    assert back == [["id", "t", "x"], ["1", "a<&>b"], ["2", None, "2.5"], ["3", " ", "1"]]
    assert sinks.workbooks(odd.limit(0)).count() == 0
    cells = spark.createDataFrame([("{'a': (1, 2)}",), ('{"b":null,"a":[1]}',), ("3",), (None,), ("[[[1]]]",), ("[Infinity]",), ("__import__('os')",)], "c string")
    assert [r[0] for r in cells.select(sinks.parse_nested(F.col("c"))).collect()] == ['{"a":[1,2]}', '{"a":[1],"b":null}', None, None, "[[[1]]]", None, None]
    columns = "activity_id string, activity_name string, volume double, measurement string, structure array<int>, edges array<int>, granular_unit struct<code:string>"
    rows = spark.createDataFrame([("1", '=a "b", c', 2.0, None, [1], [], None)], columns)
    sinks.write_activities(rows.coalesce(1), str(tmp_path / "out"))
    text_ = next((tmp_path / "out").glob("part-*")).read_text()
    assert text_ == ",".join(sinks.ACTIVITY_COLUMNS) + '\n1,"\'=a ""b"", c",2.0,,[1],[],\n'
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_activities(rows, str(tmp_path / "out"))


def test_status_of_a_well_document_is_that_of_its_first_well(spark):
    head = '<wells xmlns="http://www.witsml.org/schemas/1series" version="1.4.1.1">'
    full, bare = '<well uid="1"><name>a</name><wellheadElevation uom="m">2</wellheadElevation></well>', '<well uid="2"><name>b</name></well>'
    docs = [("x", f"{head}{full}{bare}</wells>"), ("y", f"{head}{bare}{full}</wells>"), ("z", f"{head}</wells>"), ("v", head.replace("1.4.1.1", "2.0") + full + "</wells>"), ("n", None)]
    found = files.wells(spark.createDataFrame(docs, "path string, xml string").selectExpr("path", "cast(xml as binary) content")).collect()
    assert {(r["path"], r["uid"], r["status"], tuple(r["missing_fields"])) for r in found if r["path"] in "xy"} == {
        ("x", "1", "ok", ()), ("x", "2", "ok", ("wells[1].elevation",)), ("y", "2", "incomplete", ("wells[0].elevation",)), ("y", "1", "incomplete", ()),
    }
    assert {r["path"]: r["status"] for r in found if r["path"] in "zv"} == {"z": "corrupt", "v": "unsupported"}
    assert all(r["uid"] is None for r in found if r["path"] == "n")


def test_embed_checks_batches(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "  "), (4, "c")], "id int, t string")
    sizes = vectors.embed(df, "t", lambda texts: [[float(len(t)), float(len(texts))] for t in texts], 2, batch=1)
    assert {r["id"]: r["embedding"] for r in sizes.collect()} == {1: [2.0, 1.0], 2: None, 3: None, 4: [1.0, 1.0]}
    for wrong in (lambda texts: [[1.0]] * len(texts), lambda texts: [[1.0, float("nan")]] * len(texts)):
        with pytest.raises(Exception, match="the model gave"):
            vectors.embed(df, "t", wrong, 2).collect()
    with pytest.raises(ValueError, match="1 to 128"):
        vectors.embed(df, "t", lambda texts: [], 2, batch=129)


def test_delimited_files_stay_bounded(spark, tmp_path, monkeypatch):
    from quarrylake.plans import knowledge

    part = spark.range(25_000).selectExpr("id as p_partkey", "concat('part;', id) as p_name", "1 as p_size")
    part.write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(knowledge, "scratch_path", lambda s, label: str(tmp_path / label))
    found = knowledge.csv_file_scan(spark, str(tmp_path))
    assert found.count() == 25_000 and found.exceptAll(part.selectExpr("p_partkey", "p_name", "'utf-8'", "';'")).count() == 0
    lines = [f.read_text().count("\n") for f in (tmp_path / "delimited").glob("part-*")]
    assert sum(lines) - len(lines) == 25_000 and max(lines) <= 5001


def test_components_with_hubs(spark):
    pairs = [(0, k) for k in range(1, 3000)] + [(9000, k) for k in range(5000, 8000)] + [(2999, 5000), (10000, 10001)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert len(found) == 3000 + 3001 + 2
    assert {found[k] for k in (0, 2999, 5000, 7999, 9000)} == {0} and found[10001] == 10000


def test_probed_neighbours_reach_the_recall_and_all_cells_are_exact(spark):
    import random

    rng = random.Random(7)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(k, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]) for k in range(600)] + [(1000, None), (1001, [])]
    e = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("vector", F.when(F.size("vector") > 0, vectors.normalize(F.col("vector"))).otherwise(F.col("vector"))).repartition(3)
    asked = e.where("id % 10 = 0 and id < 1000").withColumnRenamed("id", "query_id")
    exact = vectors.nearest(asked, e, 5)
    brute = {}
    held = {r["id"]: r["vector"] for r in e.collect() if r["vector"]}
    for q in asked.collect():
        near = sorted((round(1 - sum(a * b for a, b in zip(q["vector"], v, strict=True)), 5) + 0.0, i) for i, v in held.items())[:5]
        brute |= {(q["query_id"], n + 1): i for n, (_, i) in enumerate(near)}
    assert {(r["query_id"], r["rank"]): r["id"] for r in exact.collect()} == brute
    middle = vectors.centers(e, 12)
    probes, share = vectors.probes_for(asked, e, 5, middle)
    assert share >= 0.9 and probes < 12
    assert vectors.recall(vectors.nearest_probed(asked, e, 5, middle, probes), exact) >= 0.9
    assert sorted(map(tuple, vectors.nearest_probed(asked, e, 5, middle, 12).collect())) == sorted(map(tuple, exact.collect()))
    assert vectors.nearest(asked.limit(0), e, 5).count() == 0 and vectors.nearest(asked, e.limit(0), 5).count() == 0


def test_many_queries_are_one_pass_and_equal_brute_force(spark, monkeypatch):
    """Queries of many cells go to the tasks once, not once for each cell, and rows are put into cells once."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 6)), 1)
    x[::3] *= 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([x, x[:400], x[:400] * 3.0])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [1.0]), (5002, [0.5, None, 0.5, 0.1, 0.2, 0.3]), (5003, [float("nan")] * 6)]
    e = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = e.where("id % 5 = 0 and id < 5000").withColumnRenamed("id", "query_id")
    distance = np.round(1 - x @ x.T, 5) + 0.0
    middle, jobs, cells = vectors.centers(e.where("id < 5000"), 8), [], []
    near, cells_of = vectors._near, vectors._cells_of
    monkeypatch.setattr(vectors, "_near", lambda *a: jobs.append(1) or near(*a))
    monkeypatch.setattr(vectors, "_cells_of", lambda df, m, probes, into: cells.append(probes) or cells_of(df, m, probes, into))
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 100)
    own = (x @ middle.T).argmax(1)
    held = vectors.in_cells(e, middle)
    for probes in (3, 8):
        jobs.clear()
        found = vectors.nearest_probed(asked, held, 4, middle, probes).collect()
        assert len(jobs) == 1
        got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in found}
        for q in range(0, len(x), 5):
            near_cells = set(np.argsort(-(middle @ x[q]), kind="stable")[:probes].tolist())
            of = sorted((distance[q, k], k) for k in range(len(x)) if own[k] in near_cells)[:4]
            assert [got[q, n + 1] for n in range(len(of))] == [(i, d) for d, i in of]
    assert cells.count(1) == 1
