"""SEG-Y headers with all fields and both text codes; WITSML documents of every status."""

import struct

from quarrylake.sources import formats


def segy(text, fields, size=3600):
    head = bytearray(text.ljust(3200)[:3200] if isinstance(text, bytes) else text.encode("cp500").ljust(3200, b"\x40")) + bytearray(400)
    for name, at, width in formats.SEGY_FIELDS:
        if name in fields:
            head[at - 1 : at - 1 + width] = struct.pack({1: ">B", 2: ">h", 4: ">i"}[width], fields[name])
    return bytes(head[:size]) + b"trace" * (size > 3600)


def test_segy(spark):
    every = {n: (-k if w > 1 else k) for k, (n, _, w) in enumerate(formats.SEGY_FIELDS)} | {"SEGYRevision": 1, "SEGYRevisionMinor": 3, "JobID": -(2**31), "LineNumber": 2**31 - 1}
    rows = [("ascii", segy(b"C 1 CLIENT", every)), ("ebcdic", segy("C 1 CLIENT é", {"SEGYRevision": 0}, 3700)), ("neither", segy(b"\xff" * 9, {})), ("new", segy(b"C 1", {"SEGYRevision": 2})), ("short", segy(b"C 1", {}, 3599)), ("none", b""), ("null", None)]
    got = {r["path"]: r for r in formats.segy(spark.createDataFrame(rows, "path string, content binary"), "C 1").collect()}
    assert {p: (r["status"], r["reason"], r["version"], r["marked"]) for p, r in got.items()} == {
        "ascii": ("ok", None, "1.3", True), "ebcdic": ("ok", None, "0.0", True), "neither": ("ok", None, "0.0", False), "new": ("unsupported_version", "segy_revision_ge_2", "2.0", True),
        "short": ("corrupt_input", "truncated_header", None, None), "none": ("empty", "empty_file", None, None), "null": ("empty", "empty_file", None, None),
    }
    assert got["ascii"]["header"] == every
    assert got["ebcdic"]["text"].startswith("C 1 CLIENT é") and len(got["ebcdic"]["text"]) == 3200


NS = f'xmlns="{formats.WITSML_NAMESPACE}"'
FULL = (
    "<name> A </name><field>F</field><timeZone>Z</timeZone><wellheadElevation uom='m'>5</wellheadElevation><country>NO</country><operator> </operator><waterDepth uom='ft'>9</waterDepth><pcInterest>3</pcInterest>"
    "<wellLocation><latitude uom='deg'>60.5</latitude><easting>1</easting></wellLocation>"
)


def test_witsml(spark):
    docs = {
        "ok": f"<?xml version='1.0'?><!-- <wells> --><wells {NS} version='1.4.1.1'><well uid='u'>{FULL}</well><well uid=' '>\n  <name>B</name>\n <wellheadElevation>5</wellheadElevation></well></wells>",
        "alone": f"<well uid='u'>{FULL}</well>",
        "prefixed": f"<w:wells xmlns:w='{formats.WITSML_NAMESPACE}' version='1.4.1.1'><w:well uid='u'><w:name>A</w:name></w:well></w:wells>",
        "newer": f"<Well xmlns='{formats.WITSML_NEWER}'/>",
        "two": f"<wells {NS} version='2.0'><well/></wells>",
        "older": "<wells version='1.3.1.1'><well uid='u'/></wells>",
        "strange": "<wells xmlns='urn:x'><well uid='u'/></wells>",
        "odd": f"<wells {NS} version='1.4.0'><well uid='u'/></wells>",
        "bare": f"<wells {NS} version='1.4.1.1'></wells>",
        "cut": f"<wells {NS} version='1.4.1.1'><well uid='u'><name>A",
        "text": "no xml",
        "none": "",
        "null": None,
    }
    df = spark.createDataFrame([(k, None if v is None else v.encode()) for k, v in docs.items()], "path string, content binary")
    found = formats.witsml(df).collect()
    by = {(r["path"], r["place"]): r for r in found}
    assert {(r["path"], r["status"], r["reason"]) for r in found} == {
        ("ok", "ok", None), ("alone", "ok", None), ("prefixed", "incomplete", "missing_fields"), ("newer", "unsupported_version", "witsml_2x"), ("two", "unsupported_version", "witsml_2x"),
        ("older", "unsupported_version", "witsml_1.3.1.1"), ("strange", "unsupported_version", "witsml_unexpected_version"), ("odd", "unsupported_version", "witsml_unexpected_version"),
        ("bare", "empty", "no_well_object"), ("cut", "corrupt_input", "not_well_formed"), ("text", "corrupt_input", "not_well_formed"), ("none", "empty", "empty_file"), ("null", "empty", "empty_file"),
    }
    first = by["ok", 0]
    assert (first["uid"], first["name"], first["field"], first["time_zone"], tuple(first["elevation"]), first["missing"], first["version"]) == ("u", "A", "F", "Z", ("5", "m"), [], "1.4.1.1")
    assert first["texts"] == {"country": "NO"}
    assert {k: tuple(v) for k, v in first["measures"].items()} == {"waterDepth": ("9", "ft"), "pcInterest": ("3", None)}
    assert {k: tuple(v) for k, v in first["location"].items()} == {"latitude": ("60.5", "deg"), "easting": ("1", None)}
    assert by["alone", 0]["texts"] == {"country": "NO"} and by["alone", 0]["name"] == "A"
    assert by["ok", 1]["missing"] == ["wells[1].wellheadElevation.uom", "wells[1].field", "wells[1].timeZone"]
    assert by["prefixed", 0]["missing"] == ["wellheadElevation", "field", "timeZone"]
    assert formats.witsml(df.limit(0)).count() == formats.segy(df.limit(0), "C").count() == 0


def test_geojson(spark):
    point = lambda x, y: '{"type":"Feature","properties":{"id":7,"n":"a"},"geometry":{"type":"Point","coordinates":[%s,%s]}}' % (x, y)
    polygon = '{"properties":null,"geometry":{"type":"Polygon","coordinates":[[[1,2],[5,2],[3,-4],[1,2]],[[0,0]]]}}'
    docs = {
        "good": f'{{"features":[{point(1.5, 2)},{polygon}]}}', "few": f'{{"features":[{point(1, 2)}]}}', "none": '{"features":[]}', "far": f'{{"features":[{point(181, 2)}]}}', "short": '{"features":[{"geometry":{"type":"Point","coordinates":[1]}}]}',
        "line": '{"features":[{"geometry":{"type":"LineString","coordinates":[[1,2]]}}]}', "null": None, "text": "x", "map": '{"features":{}}', "bare": '{"features":[{}]}', "hole": '{"features":[{"geometry":{"type":"Polygon","coordinates":[]}}]}',
    }
    files = spark.createDataFrame(list(docs.items()), "path string, content string")
    due = spark.createDataFrame([("good", 2), ("few", 2), ("none", 0), ("gone", 1), ("far", 9)], "path string, n long")
    features, problems = formats.geojson(files, due)
    assert {tuple(r) for r in problems.collect()} == {(n, "geometry") for n in ("far", "short", "line", "bare", "hole")} | {(n, "invalid") for n in ("null", "text", "map")} | {("few", "count"), ("gone", "missing")}
    first, second = sorted(features.collect(), key=lambda r: r["place"])
    assert tuple(first) == ("good", 0, "Point", {"id": "7", "n": "a"}, 1.5, 2.0, "POINT (1.5 2.0)", None, None, None, None)
    assert tuple(second)[2:] == ("Polygon", None, None, None, None, 1.0, 5.0, -4.0, 2.0)


def test_field_months(spark):
    from quarrylake.operators import production

    rows = [(1, 2020, 12, "1.5", "0", "NULL"), (1, 2020, 13, "1", "1", "1"), (2, 2021, 1, " ", None, "7")]
    df = spark.createDataFrame(rows, "f long, y int, m int, prfPrdOilNetMillSm3 string, prfPrdGasNetBillSm3 string, prfInvestmentsMillNOK string")
    got = {r["entity"]: r for r in production.field_months(df, *map(df.__getitem__, ("f", "y", "m"))).collect()}
    assert set(got) == {1, 2} and (str(got[1]["period_start"]), str(got[1]["period_end"])) == ("2020-12-01", "2021-01-01")
    assert [got[1][c] for c in ("oilNetVolumeSm3", "gasNetVolumeSm3", "waterVolumeSm3", "investmentMillionNok", "unit")] == [1.5e6, 0.0, None, None, "Sm3"]
    assert [got[2][c] for c in ("oilNetVolumeSm3", "gasNetVolumeSm3", "investmentMillionNok")] == [None, None, 7.0]
    assert len(production.FIELD_MEASURES) == 10
