"""Control questions, ordered snapshots, sheets, dictionaries and the checks of news briefs, edges included."""

from pathlib import Path

from pyspark.sql import functions as F

from quarrylake.operators import briefs, controls, tabular, vectors
from quarrylake.storage import scratch_path

NODES = "label string, key string, properties map<string,string>"
EDGES = "type string, start_key string, end_key string"
QUESTIONS = "id string, form string, label string, subject string, path array<string>"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def world(spark):
    nodes = spark.createDataFrame(
        [
            ("Well", "w1", {"name": "A", "z": "1", "b": "2"}), ("Well", "w2", {"name": "B"}), ("Bore", "b1", {"name": "x"}), ("Bore", "b2", {"name": "x"}),
            ("Bore", "b3", {"other": "y"}), ("Log", "l1", {"name": "log"}), ("Log", "l2", {"name": "log"}), ("Log", "l3", {"name": "alone"}),
        ],
        NODES,
    )
    edges = spark.createDataFrame([("UP", "b1", "w1"), ("UP", "b2", "w1"), ("UP", "b3", "w1"), ("IN", "l1", "b1"), ("IN", "l2", "b2"), ("IN", "l3", "none")], EDGES)
    return nodes, edges


def test_controls(spark):
    nodes, edges = world(spark)
    asked = spark.createDataFrame(
        [
            ("linked", "linked", "Bore", "w1", ["UP"]), ("none", "linked", "Bore", "w2", ["UP"]), ("path", "path", "Log", "log", ["IN", "UP"]), ("short", "path", "Log", "log", ["IN"]),
            ("broken", "path", "Log", "alone", ["IN", "UP"]), ("key", "key", "Bore", "x", []), ("wells", "count", "Well", None, []), ("rigs", "count", "Rig", None, []), ("odd", "odd", "Well", "A", []),
        ],
        QUESTIONS,
    )
    given = controls.answers(asked, nodes, edges)
    assert rows(given) == sorted(
        [("linked", "x"), ("linked", "x"), ("path", "x > A"), ("path", "x > A"), ("short", "x"), ("short", "x"), ("key", "b1"), ("key", "b2"), ("wells", "2"), ("rigs", "0")], key=str
    )
    expected = spark.createDataFrame([("linked", "x"), ("linked", "x"), ("path", "x > A"), ("key", "b2"), ("key", "b3"), ("wells", "2"), ("rigs", "0"), ("short", "x"), ("short", None), ("odd", "A"), ("not asked", "A")], "id string, value string")
    told = {r["id"]: tuple(r)[1:] for r in controls.results(asked, expected, given).collect()}
    assert told == {
        "linked": (True, 2, 2, 0, 0), "none": (True, 0, 0, 0, 0), "path": (False, 1, 2, 0, 1), "short": (False, 2, 2, 1, 1), "broken": (True, 0, 0, 0, 0),
        "key": (False, 2, 2, 1, 1), "wells": (True, 1, 1, 0, 0), "rigs": (True, 1, 1, 0, 0), "odd": (False, 1, 0, 1, 0),
    }
    assert controls.results(asked.limit(0), expected, given).count() == 0
    assert rows(controls.answers(asked, nodes.limit(0), edges.limit(0))) == [("rigs", "0"), ("wells", "0")]


def test_snapshot_is_sorted_as_a_whole(spark):
    nodes, edges = world(spark)
    path = scratch_path(spark, "snapshot")
    told = {r["kind"]: r["rows"] for r in controls.snapshot(nodes.repartition(7), edges.repartition(5), path).collect()}
    assert told == {"nodes": 8, "edges": 6}
    lines = lambda p, kind: [line for f in sorted(Path(p, kind).glob("part-*")) for line in f.read_text().splitlines()]
    keys = [line.split('"key":"')[1][:2] for line in lines(path, "nodes")]
    assert keys == ["b1", "b2", "b3", "l1", "l2", "l3", "w1", "w2"]
    assert '{"key":"w1","label":"Well","properties":{"b":"2","name":"A","z":"1"}}' in lines(path, "nodes")
    assert lines(path, "edges")[0] == '{"end_key":"b1","start_key":"l1","type":"IN"}' and len(lines(path, "edges")) == 6
    again = scratch_path(spark, "snapshot")
    digests = [{r["kind"]: r["digest"] for r in controls.snapshot(n, edges, scratch_path(spark, "snapshot")).collect()} for n in (nodes.coalesce(1), nodes.where("key <> 'w2'"))]
    assert digests[0]["edges"] == digests[1]["edges"] and digests[0]["nodes"] != digests[1]["nodes"]
    assert rows(controls.snapshot(nodes.limit(0), edges.limit(0), again)) == [("edges", 0, None), ("nodes", 0, None)]


def test_sheets(spark):
    cells = "path string, row int, cells array<string>"
    held = spark.createDataFrame(
        [
            ("good", 1, ["a", "b", "c"]), ("good", 2, ["1", None, "x"]), ("good", 3, [None, None, "x"]), ("good", 4, ["2"]), ("good", 5, []), ("head", 1, ["a", "c", "b"]), ("head", 2, ["1", "2", "3"]),
            ("wide", 1, ["a", "b", "c", "d"]), ("wide", 2, ["1", "2", "3"]), ("lost", 2, ["1", "2", "3"]), ("few", 1, ["a", "b", "c"]), ("few", 2, ["1", "2", "3"]), ("bare", 1, ["a", "b", "c"]),
            ("null", 1, None), ("hole", 1, ["a", None, "c"]),
        ],
        cells,
    )
    due = spark.createDataFrame([("good", 2), ("few", 2), ("bare", 0), ("gone", 1), ("head", 5)], "path string, n long")
    records, problems = tabular.sheet_records(held, ["a", "b", "c"], ["a", "b"], due)
    assert rows(records) == [("good", 2, "1", None, "x"), ("good", 4, "2", None, None)]
    assert rows(problems) == [("few", "count"), ("gone", "missing"), ("head", "header"), ("hole", "header"), ("lost", "header"), ("null", "header"), ("wide", "header")]
    records, problems = tabular.sheet_records(held.limit(0), ["a"], ["a"])
    assert records.count() == problems.count() == 0


def test_dictionaries(spark):
    files = spark.createDataFrame(
        [
            ("good", '{"version":"3","terms":[{"id":"a","x":[1]},{"id":"b"}]}'), ("twice", '{"version":"3","terms":[{"id":"a"},{"id":"a"}]}'), ("empty", '{"version":"3","terms":[]}'),
            ("number", '{"version":3,"terms":[{"id":"a"}]}'), ("blank", '{"version":"3","terms":[{"id":" "}]}'), ("plain", '{"version":"3","terms":["a"]}'), ("map", '{"version":"3","terms":{"id":"a"}}'),
            ("list", "[1]"), ("cut", '{"version":"3"'), ("null", None), ("other", '{"version":"3","words":[{"id":"a"}]}'), ("unasked", "x"),
        ],
        "path string, content string",
    )
    names = [r["path"] for r in files.collect() if r["path"] != "unasked"] + ["gone"]
    wanted = spark.createDataFrame([(n, "terms") for n in names], "path string, field string")
    entries, problems = briefs.dictionaries(files, wanted)
    assert rows(entries.select("path", "version", "id")) == [("good", "3", "a"), ("good", "3", "b")]
    assert {tuple(r) for r in problems.collect()} == {("gone", "MISSING_FILE"), ("twice", "DUPLICATE_ID")} | {(n, "INVALID_INPUT") for n in ("empty", "number", "blank", "plain", "map", "list", "cut", "null", "other")}


def test_terminology(spark):
    held = spark.createDataFrame([(1, "old wells", "old wells", "1", "2"), (2, "x", "y", "1", "2"), (3, "x", "x", "0", "2"), (4, None, None, "1", None)], "brief_id long, query string, asked string, terms_version string, taxonomy_version string")
    mentions = spark.createDataFrame(
        [
            (1, 0, "detected", "well", None, "r", "wells"), (1, 1, "detected", "well", None, "r", "bores"), (1, 2, "expansion", "well", None, "r", "bores"), (1, 3, "detected", "rig", None, "r", "wells"),
            (1, 4, "exclusion", None, None, "r", None), (1, 5, "exclusion", None, "c", "r", None), (1, 6, "exclusion", "well", "d", "r", None), (1, 7, "detected", "well", None, " ", "wells"),
            (1, 8, "guess", "well", None, "r", "wells"), (1, 9, "expansion", "well", None, "r", ""), (9, 0, "detected", "well", None, "r", "wells"), (4, 0, "detected", "well", None, "r", "wells"),
        ],
        "brief_id long, place long, kind string, term_id string, category_id string, reason string, fragment string",
    )
    terms, categories = spark.createDataFrame([("well",), ("well",)], "term_id string"), spark.createDataFrame([("c",)], "category_id string")
    found = briefs.terminology_problems(held, mentions, terms, categories, {"terms": "1", "taxonomy": "2"})
    assert {tuple(r) for r in found.collect()} == {
        (2, None, "VERSION_MISMATCH"), (3, None, "VERSION_MISMATCH"), (4, None, "VERSION_MISMATCH"), (1, 1, "INVALID_EVIDENCE"), (1, 3, "UNKNOWN_ID"), (1, 4, "INVALID_INPUT"), (1, 6, "UNKNOWN_ID"),
        (1, 7, "INVALID_INPUT"), (1, 8, "INVALID_INPUT"), (1, 9, "INVALID_INPUT"), (9, 0, "UNKNOWN_ID"), (4, 0, "INVALID_EVIDENCE"),
    }


def test_critique(spark):
    note = "note_id string, issue string, action string, resolution string, resolution_reason string"
    notes = spark.createDataFrame([("n1", "i", "a", "resolved", "r"), ("n2", "i", "a", "unresolved", "r"), ("n3", " ", "a", "resolved", "r"), ("n4", "i", "a", None, "r"), ("n2", "i", "a", "unresolved", "r")], note)
    targets = spark.createDataFrame([("n1", "event", "gone"), ("n2", "event", "gone"), ("n1", "event", "e1"), ("n1", "event", "never"), ("n1", "source", "s1"), ("n2", "source", "s9"), ("n7", "source", "s1")], "note_id string, kind string, target string")
    reviewed = spark.createDataFrame([("gone", "s1"), ("e1", "s8"), ("e2", None)], "event_id string, source_id string")
    events, sources = spark.createDataFrame([("e1",)], "event_id string"), spark.createDataFrame([("s1",)], "source_id string")
    check = lambda cycle: {tuple(r)[1:] for r in briefs.critique_problems(notes, targets, reviewed, events, sources, cycle).collect()}
    always = {("repeated_note", "n2"), ("blank_text", "n3"), ("resolution", "n4"), ("unknown_note", "n7"), ("unknown_source", "n2:s9"), ("unknown_event", "n1:never"), ("removed_event", "n2:gone"), ("reviewed_source", "e1:s8")}
    assert check(1) == always
    assert check(0) == always | {("removed_event", "n1:gone")}
    assert check(2) == always | {("removed_event", "n1:gone"), ("cycle", "2")}


def test_column_rules(spark):
    cases = [(None, "missing"), ("", "blank"), ("  ", "blank"), ("a\0b", "nul"), (" a", "untrimmed"), ("a ", "untrimmed"), ("a" * 200, None), ("a" * 201, "too_long"), ("é" * 200, None)]
    df = spark.createDataFrame(cases, "t string, code string")
    assert all(r["code"] == r["found"] for r in df.withColumn("found", briefs.text_problem(F.col("t"), "category")).collect())
    lists = spark.createDataFrame([(["b", "a", "b", None], "z"), (None, None), (["b"], ""), (["z"], "z")], "l array<string>, d string")
    assert [r[0] for r in lists.select(briefs.limitations(F.col("l"), F.col("d"))).collect()] == [["a", "b", "z"], [], ["b"], ["z"]]
    assert [r[0] for r in lists.select(briefs.distinct_in_order(F.col("l"))).collect()] == [["b", "a", None], [], ["b"], ["z"]]
    held = spark.createDataFrame([([0.5, -1.0, None],), ([],), (None,)], "v array<float>")
    assert [r[0] for r in held.select(vectors.literal(F.col("v"))).collect()] == ["[0.5,-1.0,null]", "[]", None]


def test_period_and_sources(spark):
    held = spark.createDataFrame([(1, "s", "u", "include", "2024-02-01"), (2, "s", "u", "include", None), (3, "s", None, "include", "2024-01-01"), (4, "t", "u", "exclude", "2023-01-01")], "publication_id long, source string, url string, decision string, day string")
    entries, members = briefs.sources(held)
    assert rows(entries) == [("s", "u", 2, 1), ("s", None, 1, 3)] or rows(entries) == [("s", None, 1, 3), ("s", "u", 2, 1)]
    assert members.count() == 3
    assert rows(briefs.period(held, "day")) == [("2023-01-01", "2024-02-01", 4)]
    assert rows(briefs.period(held.limit(0), "day")) == [(None, None, 0)]
