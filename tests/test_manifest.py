"""Manifests: records at any depth, each reason, and a load that is refused or whole."""

import hashlib
import json

import pytest

from quarrylake.operators import manifest
from quarrylake.sources import publish
from quarrylake.storage import scratch_path, stash

ENVELOPE = "osdu:wks:Manifest:1.0.0"


def well(n, **more):
    return {"id": f"osdu:master-data--Well:w{n}:", "kind": "osdu:wks:master-data--Well:1.0.0", "data": {"FacilityName": f" well {n} ", "FacilityID": n, "Other": 1}} | more


def bore(n, w, **more):
    return {"id": f"osdu:master-data--Wellbore:b{n}", "kind": "osdu:wks:master-data--Wellbore:1.1.0", "data": {"Name": f"bore {n}", "WellID": f"osdu:master-data--Well:w{w}:", "SequenceNumber": 1.5}} | more


def log(n, b, **more):
    return {"id": f"osdu:work-product-component--WellLog:l{n}", "kind": "osdu:wks:work-product-component--WellLog:1.0.0", "data": {"Name": f"log {n}", "WellboreID": f"osdu%3Amaster-data--Wellbore:b{b}", "TopMeasuredDepth": True}} | more


def files(spark, *docs):
    rows = [(f"f{k}", d if isinstance(d, bytes) else json.dumps(d, ensure_ascii=False).encode()) for k, d in enumerate(docs)]
    return spark.createDataFrame(rows, "path string, content binary")


def judged(spark, *docs):
    records, issues = manifest.walk(files(spark, *docs))
    found = manifest.judge(records).orderBy("path", "place").collect()
    return found, sorted((r["source"], r["reason"], r["fatal"]) for r in issues.collect())


def test_depths_and_scope(spark):
    nested = well(6)
    for k in range(5):
        nested = {"x": [nested]} if k % 2 else [{"y": nested}, "text", 5, None]
    out_of_scope = {"kind": "osdu:wks:dataset--File.Generic:1.0.0", "data": {"inner": well(99)}}
    docs = [
        well(1), [well(2), out_of_scope, [[well(3)]]],
        {"kind": ENVELOPE, "MasterData": [well(4)], "Data": {"WorkProductComponents": [log(1, 1)], "Datasets": [out_of_scope], "WorkProduct": {"kind": "osdu:wks:work-product--WorkProduct:1.0.0", "x": well(98)}}},
        {"kind": ENVELOPE, "deep": {"kind": ENVELOPE, "again": [{"no kind": {"z": well(5)}}]}}, nested, {"kind": 5, "below": well(7)},
    ]
    found, issues = judged(spark, *docs)
    assert [r["key"] for r in found if r["label"] == "Well"] == [f"osdu:master-data--Well:w{k}" for k in (1, 2, 3, 4, 5, 6, 7)]
    assert all(r["reason"] is None for r in found) and not issues
    assert max(len(r["place"]) for r in found) >= 6


def test_broken_files(spark):
    docs = [b"{", b"\xff\xfe[]", b'{"a":1,"a":2}', [], {"x": 1}, 5, b"\xef\xbb\xbf" + json.dumps(well(1)).encode(), {"kind": "osdu:wks:dataset--File:1.0.0"}]
    found, issues = judged(spark, *docs)
    assert len(found) == 1 and found[0]["name"] == "well 1"
    assert issues == [("f0", "invalid JSON", True), ("f1", "invalid JSON", True), ("f2", "invalid JSON", True), *((f"f{k}", "no supported records", True) for k in (3, 4, 5, 7))]


REASONS = [
    (well(1, kind="osdu:wks:master-data--Well"), "unsupported kind"), (well(1, kind="osdu:wks:work-product-component--Well:1.0.0"), "unsupported kind"), (well(1, kind=None), "unsupported kind"),
    (well(1, kind="osdu:wks:master-data--WellPlan:1.0.0"), "unsupported kind"), (well(1, data=[1]), "missing data"), (well(1, data=None), "missing data"),
    (well(1, id=None), "wrong id"), (well(1, id="osdu:master-data--Wellbore:w1"), "wrong id"), (well(1, id="other:master-data--Well:w1"), "wrong id"), (well(1, id=" : "), "wrong id"), (well(1, id=7), "wrong id"),
    (log(1, 1, id=None, data={"Name": "x", "WellboreID": "nothing"}), "missing id"), (log(1, 1, id="surrogate-key:5", data={"WellboreID": "osdu:master-data--Wellbore:b1"}), "missing id"),
    (log(1, 1, id="osdu:master-data--Well:l1"), "wrong id"), (well(1, data={"FacilityName": "  ", "Name": 5}), "missing name"), (bore(1, 1, data={"Name": "x"}), "invalid parent"),
    (bore(1, 1, data={"Name": "x", "WellID": "osdu:master-data--Wellbore:b2"}), "invalid parent"), (log(1, 1, data={"Name": "x", "WellboreID": 5}), "invalid parent"),
]


def test_reasons(spark):
    found, _ = judged(spark, *(record for record, _ in REASONS))
    assert {r["path"]: r["reason"] for r in found} == {f"f{k}": reason for k, (_, reason) in enumerate(REASONS)}


def test_properties_and_fallback_id(spark):
    by_label = {r["label"]: r for r in judged(spark, [well(1), bore(1, 1), log(1, 1, id="surrogate-key:9")])[0]}
    assert by_label["Well"]["properties"] == {"osduId": "osdu:master-data--Well:w1", "name": "well 1", "kind": "osdu:wks:master-data--Well:1.0.0", "facilityID": "1"}
    assert by_label["Wellbore"]["properties"]["sequenceNumber"] == "1.5" and by_label["Wellbore"]["parent"] == "osdu:master-data--Well:w1"
    identity = json.dumps(["osdu:master-data--Wellbore:b1", "log 1", "osdu:wks:work-product-component--WellLog:1.0.0"], separators=(",", ":"))
    assert by_label["WellLog"]["key"] == "urn:osdu-demo:WellLog:" + hashlib.sha256(identity.encode()).hexdigest()
    assert by_label["WellLog"]["properties"]["topMeasuredDepth"] == "true"


def test_load_whole_or_refused(spark):
    path = scratch_path(spark, "graph")
    good = [[well(1), well(2), bore(1, 1), bore(2, 2)], log(1, 1), log(2, 2), well(1), well(2, data={"FacilityName": "other"})]
    built = manifest.build(files(spark, *good))
    counts = {r["measure"]: r["n"] for r in manifest.report(built).collect()}
    assert counts == {"records": 8, "Well": 2, "Wellbore": 2, "WellLog": 2, "BELONGS_TO_WELL": 2, "BELONGS_TO_WELLBORE": 2, "issues": 1, "fatal": 0, "passed": 1}
    first = manifest.load(spark, built, path)
    assert first["counts"] == {"nodes": 6, "edges": 4} and manifest.load(spark, built, path)["unchanged"]
    for bad in ([*good, bore(3, 9)], [*good, b"{"], good[:1]):
        built = manifest.build(files(spark, *bad))
        with pytest.raises(publish.Refused, match="FATAL_ISSUES"):
            manifest.load(spark, built, path)
        assert publish.read(spark, path, "nodes").count() == 6
    wrong = manifest.build(files(spark, [well(1), bore(1, 1)], log(1, 1), bore(7, 7)))
    assert {(r["reason"], r["fatal"]) for r in wrong["issues"].collect()} == {("BELONGS_TO_WELL dangling_end", True)}


def test_whole_files_are_not_written_again(spark, monkeypatch):
    """What is written between rounds holds records only, so no reader holds many whole files at once."""
    held = []
    monkeypatch.setattr(manifest, "stash", lambda df, label, *more: held.append(stash(df, label, *more)) or held[-1])
    wide = [bore(k, 1) for k in range(200)]
    docs = [wide, {"kind": ENVELOPE, "Data": {"x": wide, "none": None}}, [{"y": [None, {"b": {"c": wide}}]}], [well(1)]]
    records, issues = manifest.walk(files(spark, *docs))
    assert records.count() == 601 and issues.count() == 0
    assert max(df.selectExpr("max(length(to_json(value)))").first()[0] for df in held) < 1000


def test_deeper_than_one_round(spark):
    nested, places = [well(1), log(1, 1)], 3 * manifest.LEVELS + 3
    for k in range(places):
        nested = {"x": nested, "w": 1} if k % 2 else [None, nested]
    found, issues = judged(spark, nested, well(2))
    assert [(r["path"], r["label"], len(r["place"])) for r in found] == [("f0", "Well", places + 1), ("f0", "WellLog", places + 1), ("f1", "Well", 0)] and not issues
    assert found[0]["place"] == [1] * places + [0] and found[1]["place"] == [1] * places + [1]


def test_a_graph_is_built_without_writing_whole_files(spark, monkeypatch):
    held = []
    monkeypatch.setattr(manifest, "stash", lambda df, label, *more: held.append((label, stash(df, label, *more))) or held[-1][1])
    wide = [[{"kind": ENVELOPE, "Data": {"x": [well(1), *(bore(k, 1) for k in range(100)), log(1, 1)]}}]]
    counts = {r["measure"]: r["n"] for r in manifest.report(manifest.build(files(spark, *wide))).collect()}
    assert counts["records"] == 102 and counts["BELONGS_TO_WELL"] == 100 and counts["passed"] == 1
    assert max(df.selectExpr("max(length(to_json(value)))").first()[0] for label, df in held if label == "manifest") < 1000
