"""Document scans: fragments of each type, and files refused as a whole."""

import json

import pytest

from quarrylake.sources import documents

GOOD = [
    ("text/plain; charset=utf-8", b"\xef\xbb\xbfone\ntwo", [("document", "one\ntwo", {})]), (" Text/Markdown", "# é".encode(), [("document", "# é", {})]),
    ("application/json", b'[{"text":"a","n":1,"m":{"z":1,"b":[true,null]}},"b",{"x":1,"a":"y"},5,[1]]',
     [("item:1", "a", {"n": 1, "m": {"z": 1, "b": [True, None]}}), ("item:2", "b", {}), ("item:3", '{"a":"y","x":1}', {"x": 1, "a": "y"}), ("item:4", "5", {}), ("item:5", "[1]", {})]),
    ("text/json", b'{"text":"only"}', [("document", "only", {})]), ("application/json", b'{"text":5}', [("document", '{"text":5}', {"text": 5})]), ("application/json", b"null", [("document", "null", {})]),
    ("application/json", b'"NaN 1e999 \\" 1e999"', [("document", 'NaN 1e999 " 1e999', {})]),
    ("application/x-ndjson", b'\n{"text":"a"}\r\n\n  \n"b"\n', [("line:2", "a", {}), ("line:5", "b", {})]),
    ("text/csv", b'name,note\na,"x\ny, ""z"""\n\nb,\n', [("row:2", 'name: a\nnote: x\ny, "z"', {"name": "a", "note": 'x\ny, "z"'}), ("row:3", "name: b\nnote: ", {"name": "b", "note": ""})]),
]
BAD = [
    ("text/plain", b"", documents.EMPTY, None), ("text/plain", None, documents.EMPTY, None), ("text/plain", b"\xef\xbb\xbf \n\t", documents.EMPTY, None), ("text/plain", b"\xff\xfe", documents.ENCODING, None),
    ("text/plain", b"a\x00b", documents.FORMAT, None), ("image/png", b"\x89PNG", documents.ENCODING, None), ("image/png", b"PNG", documents.UNSUPPORTED, None), (None, b"x", documents.UNSUPPORTED, None), ("image/png", b" ", documents.EMPTY, None),
    ("application/json", b"[1,", documents.FORMAT, "document"), ("application/json", b'[NaN]', documents.FORMAT, "document"), ("application/json", b"[1e999]", documents.FORMAT, "document"), ("application/json", b"[-1E+400]", documents.FORMAT, "document"),
    ("application/json", b'{"a":1,"a":2}', documents.FORMAT, "document"), ("application/json", b"[]", documents.EMPTY, None), ("application/json", b'["a",{"text":" "}]', documents.EMPTY, "item:2"), ("application/json", b'""', documents.EMPTY, "document"),
    ("application/jsonl", b'"a"\n{"text":Infinity}\n{', documents.FORMAT, "line:2"), ("application/jsonl", b'"a"\n" "\n', documents.EMPTY, "line:2"),
    ("text/csv", b"a,,c\n1,2,3\n", documents.FORMAT, "row:1"), ("text/csv", b"a,a\n1,2\n", documents.FORMAT, "row:1"), ("text/csv", b"a,b\n1,2\n1\n", documents.FORMAT, "row:3"), ("text/csv", b"a,b\n1,2,3\n", documents.FORMAT, "row:2"),
    ("text/csv", b"a,b\n", documents.EMPTY, None), ("text/csv", b'a,b\n"x"y,2\n', documents.FORMAT, "row:2"), ("text/csv", b'"a"b,c\n1,2\n', documents.FORMAT, "row:1"), ("text/csv", b"\na,b\n1,2\n", documents.FORMAT, "row:1"),
]


def test_fragments_and_refusals(spark):
    files = [(f"g{k}", t, c) for k, (t, c, _) in enumerate(GOOD)] + [(f"b{k}", t, c) for k, (t, c, _, _) in enumerate(BAD)]
    found, refused = documents.fragments(spark.createDataFrame(files, "path string, content_type string, content binary").repartition(3))
    held = {}
    for r in found.collect():
        held.setdefault(r["path"], {})[r["locator"]] = (r["text"], json.loads(r["metadata"]))
    assert held == {f"g{k}": {loc: (text, meta) for loc, text, meta in expected} for k, (_, _, expected) in enumerate(GOOD)}
    told = {r["path"]: (r["code"], r["locator"]) for r in refused.collect()}
    wrong = {k: (BAD[int(k[1:])], v) for k, v in told.items() if v != BAD[int(k[1:])][2:]}
    assert not wrong and len(told) == len(BAD)


@pytest.mark.parametrize("rows", [0, 1])
def test_small(spark, rows):
    found, refused = documents.fragments(spark.createDataFrame([("a", "text/plain", b"x")][:rows], "path string, content_type string, content binary"))
    assert (found.count(), refused.count()) == (rows, 0)
