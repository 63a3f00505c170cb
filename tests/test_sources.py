import json

from pyspark.sql import functions as F

from tessera.sources import coverage, datasets, files, history


def put(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


TREE = {
    "a.py": b"x = 1\n", "src/b.py": b"\xef\xbb\xbfy", "src/wide.py": b"\xff\xfe" + "zé".encode("utf-16-le"), "src/raw.bin": b"ab\xf0\x00c", "src/empty.py": b"", "node_modules/c.js": b"no",
    ".secret/d.py": b"no", ".env": b"no", "big.txt": b"b" * 50, "src/__init__.py": b"i", ".github/w.yml": b"on",
}
SEEN = [("a.py", "x = 1\n"), ("src/b.py", "y"), ("src/empty.py", ""), ("src/wide.py", "zé")]
SKIPPED = [("big.txt", "too large"), ("src/raw.bin", "binary")]


def test_source_folder(spark, tmp_path):
    for name, data in TREE.items():
        put(tmp_path / name, data)
    at = files.listing(spark, str(tmp_path))
    got = files.source_files(at, max_bytes=40)
    seen = [(p, text) for p, text in SEEN if text]  # Spark's own listing leaves out empty files and names that start with _ or .
    assert rows(got, "path", "text") == seen
    assert rows(files.source_files(at, only_code=True), "path") == [(p,) for p, _ in seen]
    assert rows(files.skipped_files(at, max_bytes=40), "path", "reason") == SKIPPED
    assert ("src", True) in rows(files.path_index(got), "path", "is_dir")


def test_source_archives(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    with tarfile.open(tmp_path / "one.tar.gz", "w:gz") as t, zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        for name, data in TREE.items():
            info = tarfile.TarInfo(f"./{name}")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
            z.writestr(name, data)
    at = files.archived(spark, str(tmp_path), max_bytes=40)
    want = sorted([*SEEN, (".github/w.yml", "on"), ("src/__init__.py", "i")], key=str)
    for tree in ("one.tar.gz", "two.zip"):
        mine = at.where(F.col("tree").endswith(tree))
        assert rows(files.source_files(mine, max_bytes=40), "path", "text") == want
        assert rows(files.skipped_files(mine, max_bytes=40), "path", "reason") == SKIPPED


def test_notebook(spark):
    text = json.dumps({"cells": [{"cell_type": "markdown", "source": ["no"]}, {"cell_type": "code", "source": ["a = 1\n", "b"]}, {"cell_type": "code", "source": "c"}]})
    df = spark.createDataFrame([("n.ipynb", text), ("bad.ipynb", "{"), ("x.py", text)], "path string, text string")
    assert rows(files.notebook_lines(df), "path", "cell", "line", "source") == [("n.ipynb", 2, 1, "a = 1"), ("n.ipynb", 2, 2, "b"), ("n.ipynb", 3, 1, "c")]


def test_jsonl_counts_every_field_apart(spark, tmp_path):
    lines = [json.dumps({"id": i, "answer": "", "n": 0, "ok": False} | ({"expected_answer": "x"} if i < 3 else {})) for i in range(412)]
    put(tmp_path / "eval.jsonl", "\n".join([*lines, "{bad", "[1]", "", "  "]))
    got = datasets.jsonl(spark, str(tmp_path))
    assert rows(datasets.counts(got), "rows", "bad_rows") == [(414, 2)]
    assert rows(datasets.field_counts(got), "field", "n", "is_label") == [("answer", 0, False), ("expected_answer", 3, True), ("id", 412, False), ("n", 412, False), ("ok", 412, False)]


def test_json_shapes(spark, tmp_path):
    for name, value in {"list": [{"a": 1}, 2], "key": {"data": [], "rows": [{"a": 1}]}, "none": {"data": []}, "one": {"label": 0}, "conf": {"x": 1}, "scalars": [1, 2]}.items():
        put(tmp_path / f"{name}.json", json.dumps(value))
    put(tmp_path / "bad.json", "{")
    name = F.regexp_extract("file", r"([a-z]+)\.json$", 1).alias("name")
    got = datasets.json_documents(spark, str(tmp_path)).select(name, "status", F.when(F.col("records").isNotNull(), F.size("records")).alias("n"))
    assert rows(got, "name", "status", "n") == [("bad", "parse error", None), ("conf", "not a dataset", None), ("key", "records", 1), ("list", "records", 2), ("none", "records", 0), ("one", "records", 1), ("scalars", "not a dataset", None)]
    assert rows(datasets.counts(datasets.json_records(spark, str(tmp_path))).select(name, "rows", "bad_rows"), "name", "rows", "bad_rows") == [("key", 1, 0), ("list", 2, 1), ("one", 1, 0)]


def test_delimited(spark, tmp_path):
    put(tmp_path / "d.csv", 'a,b\n1,"x\ny"\n2,\n3,z,more\n4\n')
    got = datasets.delimited(spark, str(tmp_path / "d.csv"))
    assert rows(got, "a", "b", "_extra") == [("1", "x\ny", None), ("2", None, None), ("3", "z", "more"), ("4", None, None)]


def test_coverage(spark, tmp_path):
    put(tmp_path / "c.xml", '<coverage><classes><class filename="a.py"><methods><method><lines><line number="1" hits="2"/></lines></method></methods><lines><line number="1" hits="0"/></lines></class><class filename="a.py"><lines><line number="2" hits="3"/></lines></class><class filename="e.py"><lines/></class></classes></coverage>')
    assert rows(coverage.cobertura(spark, str(tmp_path / "c.xml")), "raw_path", "covered", "total") == [("a.py", 2, 3)]
    put(tmp_path / "l.info", "TN:\nSF:a.js\nDA:1,1\nDA:2,0\nend_of_record\nSF:b.js\nend_of_record\nSF:a.js\nDA:1,4\nend_of_record\nSF:c.js\nDA:1,1\n")
    assert rows(coverage.lcov(spark, str(tmp_path / "l.info")), "raw_path", "covered", "total") == [("a.js", 1, 1)]
    put(tmp_path / "g.out", "mode: set\nm/a.go:1.2,3.4 5 1\nm/a.go:4.2,6.4 2 0\nm/b.go:1.1,1.2 0 1\n")
    assert rows(coverage.go_profile(spark, str(tmp_path / "g.out")), "raw_path", "covered", "total") == [("m/a.go", 5, 7)]
    paths = spark.createDataFrame([("x/LCOV.info",), ("coverage.xml",), ("1/2/3/4/coverage.xml",), ("y.py",)], "path string")
    assert [tuple(r) for r in coverage.discover(paths).collect()] == [("coverage.xml", "cobertura", 0), ("x/LCOV.info", "lcov", 3)]


LOG = "@@s1\t2024-03-01T00:00:00Z\tann\n\nlib/hot.py\nlib/cold.py\n@@s2\t2024-04-01T00:00:00Z\tbo\n\nlib/hot.py\nother.py\n@@s3\tnever\n"


def test_touches(spark):
    got = history.touches(spark.createDataFrame([("r", LOG), ("none", ""), ("null", None)], "repo string, text string"), "lib/")
    assert rows(got, "sha", "author", "path") == [("s1", "ann", "cold.py"), ("s1", "ann", "hot.py"), ("s2", "bo", "hot.py")]
    since = F.lit("2024-03-15T00:00:00Z").cast("timestamp")
    assert rows(history.changed_since(got, since), "path") == [("hot.py",)]
    assert rows(history.depth(got, 2), "commits", "enough") == [(2, True)]
    assert rows(history.last_updated(got, "cold"), "repo") == [("r",)]


DIFF = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -1,3 +1,4 @@ def f():
 one
--- gone
+two
+three
 four
@@ -9 +10 @@
-x
+y
\\ No newline at end of file
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1 @@
+n
diff --git a/old.py b/old.py
deleted file mode 100644
--- a/old.py
+++ /dev/null
@@ -1 +0,0 @@
-o
diff --git a/p.py b/q.py
similarity index 100%
rename from p.py
rename to q.py
diff --git a/i.png b/i.png
Binary files a/i.png and b/i.png differ
"""


def test_diff(spark):
    diffs = spark.createDataFrame([(1, DIFF), (2, ""), (3, None)], "diff_id long, text string")
    assert rows(history.diff_files(diffs), "path", "old_path", "status", "binary") == [("i.png", "i.png", "M", True), ("m.py", "m.py", "M", False), ("new.py", "", "A", False), ("old.py", "old.py", "D", False), ("q.py", "p.py", "R", False)]
    assert rows(history.changed_lines(diffs), "path", "line") == [("m.py", 10), ("m.py", 2), ("m.py", 3), ("new.py", 1)]
    lines = history.diff_lines(diffs).where("path = 'm.py' and hunk_no = 0")
    assert rows(lines, "line_no", "tag", "text", "new_line") == [(0, " ", "one", 1), (1, "-", "-- gone", None), (2, "+", "two", 2), (3, "+", "three", 3), (4, " ", "four", 4)]
