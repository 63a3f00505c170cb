import json

from tessera.sources import reports

A = {"file": "a.py", "line": 3, "severity": "high", "description": "d"}


def test_reports(spark, tmp_path):
    texts = {
        "list": json.dumps([A, 5]), "cats": json.dumps({"meta": {}, "categories": {"naming": {"issues": [A, A | {"category": "own"}]}, "odd": 3}}), "issues": json.dumps({"issues": [A]}),
        "found": json.dumps({"completeness": {}, "findings": [A, A | {"kind": "candidate", "line": None}]}), "none": "{}", "zero": " ", "bad": "{", "null": None, "text": '"x"', "clean": "[]",
    }
    df = spark.createDataFrame(list(texts.items()), "source string, text string")
    status = {r.source: (r["shape"], r.readable) for r in reports.statuses(df).collect()}
    assert status == {
        "list": ("list", True), "cats": ("categories", True), "issues": ("issues", True), "found": ("findings", True), "none": ("unknown", False), "zero": ("empty", False),
        "bad": ("parse error", False), "null": ("empty", False), "text": ("unknown", False), "clean": ("list", True),
    }
    found = reports.findings(df)
    got = sorted(((r.source, r.category, r.kind, r.line) for r in found.collect()), key=str)
    assert got == sorted([("list", None, None, 3), ("cats", "naming", None, 3), ("cats", "own", None, 3), ("issues", None, None, 3), ("found", None, None, 3), ("found", None, "candidate", None)], key=str)
    assert {r.line for r in reports.as_lines(found).collect()} == {"a.py:3: [high] d", "a.py: [high] d"}
    reports.write_findings(found, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6
