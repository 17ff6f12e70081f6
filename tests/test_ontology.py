"""Ontologies: each code met, for many at once."""

from quarrylake.operators import ontology
from quarrylake.operators.ontology import DUPLICATE, REFERENCE, SCHEMA, VERSION

GOOD = [("entity", "a", "A", None, None, None, None), ("property", "a.name", "N", "string", None, None, None), ("entity", "b", "B", None, None, None, None), ("relation", "r", "R", None, "a", "b", None), ("observation", "o", "O", "number", None, None, "a"), ("condition", "o.t", "T", "integer", None, None, None)]
COVER, DOC = [("q1", "a"), ("q1", "o.t"), ("q2", "r")], ("1.1.0", "1.0.0", "1.0.0")
CASES = [
    (GOOD, COVER, DOC, None), (GOOD, COVER, ("1.0.0", None, None), None), (GOOD, [("q", "é")], DOC, REFERENCE), ([*GOOD, ("entity", "é", "E", None, None, None, None)], [("q", "é")], DOC, None),
    (GOOD, COVER, ("1.1", "1.0.0", "1.0.0"), SCHEMA), (GOOD, COVER, ("01.1.0", "1.0.0", "1.0.0"), SCHEMA), (GOOD, COVER, ("1.1.0", "x", "x"), SCHEMA), (GOOD, [], DOC, SCHEMA), ([], COVER, DOC, SCHEMA), (GOOD[1:2], [("q", "a.name")], DOC, SCHEMA),
    ([*GOOD, ("entity", " c", "C", None, None, None, None)], COVER, DOC, SCHEMA), ([*GOOD, ("entity", "c", "", None, None, None, None)], COVER, DOC, SCHEMA), ([*GOOD, ("property", "p", "P", "text", None, None, None)], COVER, DOC, SCHEMA),
    ([*GOOD, ("thing", "c", "C", None, None, None, None)], COVER, DOC, SCHEMA), ([*GOOD, ("relation", "r2", "R", None, "a", None, None)], COVER, DOC, SCHEMA), (GOOD, [*COVER, (" ", "a")], DOC, SCHEMA), ([*GOOD, ("observation", "o2", "O", "number", None, None, None)], COVER, DOC, SCHEMA),
    ([*GOOD, ("property", "r", "P", "string", None, None, None)], COVER, DOC, DUPLICATE), ([*GOOD, ("entity", "a", "A", None, None, None, None)], COVER, DOC, DUPLICATE),
    ([*GOOD, ("entity", "é", "E", None, None, None, None), ("entity", "é", "E", None, None, None, None)], COVER, DOC, DUPLICATE),
    ([*GOOD, ("relation", "r2", "R", None, "a", "c", None)], COVER, DOC, REFERENCE), ([*GOOD, ("relation", "r2", "R", None, "r", "a", None)], COVER, DOC, REFERENCE), ([*GOOD, ("observation", "o2", "O", "string", None, None, "z")], COVER, DOC, REFERENCE),
    (GOOD, [*COVER, ("q3", "nothing")], DOC, REFERENCE), (GOOD, COVER, ("1.1.0", "1.0.0", "1.0.1"), VERSION), (GOOD, COVER, ("1.0.0", "1.0.0", "1.0.0"), VERSION), (GOOD, COVER, ("1.0.0", None, "1.0.0"), VERSION),
]


def test_codes(spark):
    docs = spark.createDataFrame([(f"c{k}", *d) for k, (_, _, d, _) in enumerate(CASES)], ontology.DOCUMENTS)
    elements = spark.createDataFrame([(f"c{k}", *e) for k, (es, _, _, _) in enumerate(CASES) for e in es], ontology.ELEMENTS)
    coverage = spark.createDataFrame([(f"c{k}", *c) for k, (_, cs, _, _) in enumerate(CASES) for c in cs], ontology.COVERAGE)
    found = {r["ontology"]: r["code"] for r in ontology.judge(docs, elements, coverage).collect()}
    assert {k: (CASES[int(k[1:])], v) for k, v in found.items() if v != CASES[int(k[1:])][3]} == {} and len(found) == len(CASES)
    assert ontology.judge(docs.limit(0), elements, coverage).count() == 0
