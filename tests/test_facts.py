"""Fact batches: every code met, good and bad."""

import pytest

from quarrylake.operators import facts

SHA = "a" * 64
TEXT = "Sample A has a density of 1.5 g. Café too."
TYPES = [("entity", "recipe", None, None, None, None, None), ("entity", "part", None, None, None, None, None), ("relation", "uses", "recipe", "part", None, None, None), ("observation", "density", None, None, "recipe", "number", True), ("observation", "note", None, None, "recipe", "string_list", False), ("observation", "count", None, None, "recipe", "integer", False)]
PROPERTIES = [("entity", "recipe", "label", "string", True), ("entity", "recipe", "steps", "integer", False), ("entity", "recipe", "hot", "boolean", False), ("entity", "recipe", "ratio", "number", False), ("entity", "recipe", "café", "string", False), ("observation", "density", "temperature", "number", True), ("observation", "density", "tags", "string_list", False)]
COLUMNS = ", ".join(f"{c} string" for c in facts.COLUMNS)


def fact(kind, **more):
    base = dict.fromkeys(facts.COLUMNS) | {"batch": "b", "kind": kind, "id": "x", "source_id": "src", "fragment_id": SHA, "evidence": "density of 1.5"}
    base |= {
        "entity": {"type_id": "recipe", "properties": '{"label":"a"}'},
        "relation": {"type_id": "uses", "source_entity_id": "r", "source_type_id": "recipe", "target_entity_id": "p", "target_type_id": "part"},
        "observation": {"type_id": "density", "subject_entity_id": "r", "subject_type_id": "recipe", "value": "1.5", "unit": "g", "conditions": '{"temperature":20}'},
    }.get(kind, {})
    return base | more


def judged(spark, *rows):
    held = spark.createDataFrame([tuple(r[c] for c in facts.COLUMNS) for r in rows], COLUMNS).selectExpr("*", "1 AS row", "'x' AS code", "true AS declared")
    fragments = spark.createDataFrame([(SHA, "src", TEXT), ("b" * 64, "other", "nothing")], "fragment_id string, source_id string, text string")
    return facts.judge(held, spark.createDataFrame(TYPES, facts.TYPES), spark.createDataFrame(PROPERTIES, facts.PROPERTIES), fragments)


CASES = [
    ("entity", {}, None), ("relation", {}, None), ("observation", {}, None),
    ("entity", {"properties": '{"label":"a","steps":2,"hot":true,"ratio":1,"café":"x"}'}, None), ("entity", {"properties": '{"label":"a","ratio":1.5e3}'}, None),
    ("entity", {"id": "e\u0301"}, None), ("entity", {"evidence": "Café"}, None), ("entity", {"properties": '{"label":"a","steps":12345678901234567890123}'}, None),
    ("observation", {"type_id": "note", "value": '["a","b"]', "unit": None, "conditions": "{}"}, None), ("observation", {"type_id": "note", "value": "[]", "conditions": "{}"}, None),
    ("observation", {"type_id": "count", "value": "1" + "0" * 400, "conditions": "{}"}, None), ("observation", {"unit": "mN/mé"}, None), ("observation", {"value": "-2"}, None),
    # form
    ("thing", {}, "SCHEMA"), (None, {}, "SCHEMA"), ("entity", {"id": None}, "SCHEMA"), ("entity", {"id": " x"}, "SCHEMA"), ("entity", {"type_id": "recipe\t"}, "SCHEMA"), ("relation", {"source_type_id": "recipe "}, "ENDPOINT"), ("entity", {"id": "  "}, "SCHEMA"), ("entity", {"type_id": " "}, "SCHEMA"), ("entity", {"properties": "[1]"}, "SCHEMA"),
    ("entity", {"properties": "{"}, "SCHEMA"), ("entity", {"properties": None}, "SCHEMA"), ("entity", {"properties": '{"label":"a","label":"b"}'}, "SCHEMA"), ("entity", {"fragment_id": "xyz"}, "SCHEMA"),
    ("observation", {"value": None}, "SCHEMA"), ("observation", {"conditions": "1"}, "SCHEMA"),
    ("entity", {"evidence": None}, "EVIDENCE"), ("entity", {"evidence": " \n"}, "EVIDENCE"), ("relation", {"source_type_id": None}, "ENDPOINT"), ("relation", {"target_entity_id": " "}, "ENDPOINT"),
    ("observation", {"subject_entity_id": None}, "ENDPOINT"), ("observation", {"unit": "  "}, "MEASUREMENT"), ("observation", {"value": "NaN"}, "MEASUREMENT"), ("observation", {"unit": " ", "evidence": ""}, "SCHEMA"),
    # types and ends
    ("entity", {"type_id": "unheard"}, "TYPE"), ("relation", {"type_id": "recipe"}, "TYPE"), ("observation", {"type_id": "uses"}, "TYPE"),
    ("relation", {"target_type_id": "recipe"}, "ENDPOINT"), ("observation", {"subject_type_id": "part"}, "ENDPOINT"),
    # properties
    ("entity", {"properties": '{"label":"a","colour":"red"}'}, "TYPE"), ("entity", {"properties": '{"label":"a","café":"x"}'}, "TYPE"), ("entity", {"properties": "{}"}, "SCHEMA"),
    ("entity", {"properties": '{"label":1}'}, "SCHEMA"), ("entity", {"properties": '{"label":null}'}, "SCHEMA"), ("entity", {"properties": '{"label":"a","steps":1.0}'}, "SCHEMA"), ("entity", {"properties": '{"label":"a","steps":true}'}, "SCHEMA"),
    ("entity", {"properties": '{"label":"a","hot":"true"}'}, "SCHEMA"), ("entity", {"properties": '{"label":"a","ratio":false}'}, "SCHEMA"), ("entity", {"properties": '{"label":"a","ratio":1e999}'}, "SCHEMA"),
    # measurements
    ("observation", {"value": "true"}, "MEASUREMENT"), ("observation", {"value": '"1"'}, "MEASUREMENT"), ("observation", {"value": "null"}, "MEASUREMENT"), ("observation", {"unit": None}, "MEASUREMENT"),
    ("observation", {"conditions": "{}"}, "MEASUREMENT"), ("observation", {"conditions": '{"temperature":"20"}'}, "MEASUREMENT"), ("observation", {"conditions": '{"temperature":1,"colour":1}'}, "TYPE"),
    ("observation", {"conditions": '{"temperature":1,"tags":["a",null]}'}, "MEASUREMENT"), ("observation", {"type_id": "note", "value": '["a",1]', "conditions": "{}"}, "MEASUREMENT"), ("observation", {"type_id": "count", "value": "1.0", "conditions": "{}"}, "MEASUREMENT"),
    # evidence
    ("entity", {"source_id": "other"}, "SOURCE"), ("entity", {"fragment_id": "c" * 64}, "SOURCE"), ("entity", {"fragment_id": "b" * 64}, "SOURCE"), ("entity", {"evidence": "density  of"}, "EVIDENCE"), ("entity", {"evidence": "Café"}, "EVIDENCE"),
]


def test_codes(spark):
    rows = [fact(kind, **({"batch": f"b{k}"} | more)) for k, (kind, more, _) in enumerate(CASES)]
    found = {r["batch"]: r["code"] for r in judged(spark, *rows).collect()}
    names = {"SCHEMA": facts.SCHEMA, "TYPE": facts.TYPE, "ENDPOINT": facts.ENDPOINT, "MEASUREMENT": facts.MEASUREMENT, "SOURCE": facts.SOURCE, "EVIDENCE": facts.EVIDENCE, None: None}
    wrong = [(CASES[int(b[1:])], code) for b, code in found.items() if code != names[CASES[int(b[1:])][2]]]
    assert not wrong and len(found) == len(CASES)


def test_batches(spark):
    rows = [
        fact("entity", batch="one", id="r"), fact("entity", batch="one", id="p", type_id="part", properties="{}"), fact("relation", batch="one", id="u"), fact("observation", batch="one", id="d"),
        fact("entity", batch="two", id="r", type_id="part", properties="{}"), fact("relation", batch="two", id="u"), fact("observation", batch="two", id="d"),
        fact("entity", batch="three", id="é"), fact("entity", batch="three", id="e\u0301"), fact("entity", batch="three", id="f"),
        fact("relation", batch="four", id="u"),
    ]
    found = judged(spark, *rows).cache()
    codes = {(r["batch"], r["id"]): r["code"] for r in found.collect()}
    assert {k: v for k, v in codes.items() if v} == {("two", "u"): facts.ENDPOINT, ("two", "d"): facts.ENDPOINT, ("three", "\u00e9"): facts.DUPLICATE}
    assert {tuple(r) for r in facts.batches(found).collect()} == {("one", 4, 0, True), ("two", 3, 2, False), ("three", 3, 2, False), ("four", 1, 0, True)}
    held = spark.createDataFrame([tuple(r[c] for c in facts.COLUMNS) for r in rows], COLUMNS)
    assert sorted(r["batch"] for r in facts.accepted(held, found).collect()) == ["four"] + ["one"] * 4


@pytest.mark.parametrize("rows", [[], [fact("entity")]])
def test_small(spark, rows):
    assert [r["code"] for r in judged(spark, *rows).collect()] == [None] * len(rows)
