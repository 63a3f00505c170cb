"""A change's footprint and risk, by hand."""

from tessera.operators import diffs as D

LINES = (
    [("src/pay.py", "+", "token = read()")] * 5  # security counts twice at most
    + [("src/pay.py", "+", "retry(1)"), ("src/pay.py", "-", "password = 1"), ("src/pay.py", " ", "lock()"), ("src/pay.py", "+", None)]
    + [("tests/test_pay.py", "+", "token")] * 3  # lines of tests aren't scored
    + [("db/migrations/1.sql", "+", "commit")]
    + [("src/old.py", "-", "x")] * 51 + [("src/old.py", "+", "y")] * 25
    + [("src/even.py", "-", "x")] * 52 + [("src/even.py", "+", "y")] * 26
    + [("docs/pr-1.html", "+", "token")]
)


def files(spark):
    return D.files_of(spark.createDataFrame(LINES, "path string, tag string, text string"))


def test_risk(spark):
    rows = [(r.path, r.kind, r.adds, r.dels, r.score, r.reasons) for r in D.risk(files(spark)).collect()]
    assert rows == [
        ("src/pay.py", "source", 7, 1, 8, ["security×5", "retries/timeouts×1"]),
        ("db/migrations/1.sql", "schema/migration", 1, 0, 5, ["schema/migration", "transactions×1"]),
        ("src/old.py", "source", 25, 51, 2, ["large-removal"]),
        ("src/even.py", "source", 26, 52, 1, []),
        ("tests/test_pay.py", "test", 3, 0, 0, []),
    ]


def test_signatures_count_in_source_files(spark):
    signatures = spark.createDataFrame([("src/even.py", 2, 1), ("tests/test_pay.py", 1, 1)], "path string, changed int, removed int")
    rows = {r.path: (r.score, r.reasons) for r in D.risk(files(spark), signatures).collect()}
    assert rows["src/even.py"] == (6, ["signature-change×2", "removed-symbol×1"])
    assert rows["tests/test_pay.py"] == (0, []) and rows["src/old.py"] == (2, ["large-removal"])


def test_footprint_and_no_lines(spark):
    assert {tuple(r) for r in D.footprint(files(spark)).collect()} == {("source", 3, 58, 104), ("schema/migration", 1, 1, 0), ("test", 1, 3, 0)}
    assert D.risk(D.files_of(spark.createDataFrame([], "path string, tag string, text string"))).count() == 0
