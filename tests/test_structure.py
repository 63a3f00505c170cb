"""Cohesion, envy, shapes, regions and orphans, by hand."""

from pyspark.sql import functions as F

from tessera.operators import structure as S


def test_regions_measure_from_the_last_line_kept(spark):
    df = spark.createDataFrame([([90, 1, 40, 51, 100, 101],), ([],), ([7, 7],)], "lines array<int>")
    assert [r[0] for r in df.select(S.regions(F.col("lines"))).collect()] == [[1, 51, 101], [], [7]]


def test_cohesion(spark):
    apart = [("a", f"m{i}", f"f{i}") for i in range(4)]
    loner = [("b", f"m{i}", "x" if i < 2 else f"f{i}") for i in range(5)] + [("b", "m9", None)]  # 1 of 15 pairs shares a field
    close = [("c", f"m{i}", f) for i in range(4) for f in ("x", "y")]
    few = [("d", f"m{i}", f"f{i}") for i in range(3)]
    rows = S.low_cohesion(spark.createDataFrame(apart + loner + close + few, "class string, method string, field string")).collect()
    assert {tuple(r) for r in rows} == {("a", 6, 6, 0, "high"), ("b", 14, 15, 1, "medium")}


def test_envy(spark):
    def of(method, **touches):
        return [("c", method, None if o == "self" else o, f"m{i}") for o, n in touches.items() for i in range(n)]

    rows = of("low", p=3) + of("tie", q=4, p=4) + of("own", p=4, self=2) + of("more", p=5, self=2) + of("none", self=3) + [("c", "one", None, "m")] * 9 + of("one", p=4)
    got = S.feature_envy(spark.createDataFrame(rows, "class string, method string, object string, member string")).collect()
    assert {tuple(r) for r in got} == {("c", "tie", "p", 4, 0), ("c", "more", "p", 5, 2), ("c", "one", "p", 4, 1)}


def test_same_shapes(spark):
    a, b = [("x", "Map<a, b>"), ("y", "int"), ("z", "int")], [("z", "int"), ("y", "int"), ("x", "Map<a,b>")]
    rows = [(2, "B", b), (1, "A", a), (3, "C", a[:2]), (4, "D", b[:2]), (5, "E", [("p", "1"), ("q", "1"), ("r", "1")]), (6, "E", [("p", "1"), ("q", "1"), ("r", "1")])]
    got = S.same_shapes(spark.createDataFrame(rows, "ordinal int, name string, members array<struct<name:string,type:string>>")).collect()
    assert [tuple(r) for r in got] == [("x:Map<a,b>|y:int|z:int", "A", 2)]


def test_orphans(spark):
    one = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    paths = one("p/a.txt", "p/b.txt", "p/c.md", "q/d.txt", "p/e.py", ".p/f.txt", "p/noext", "g.txt", "h.txt")
    loaded = spark.createDataFrame([("p/a.txt", True), ("p/e.py", False), ("q/x.md", True), ("g.txt", True)], "path string, asset boolean")
    # a folder and a suffix count if some loaded asset has them, not necessarily the same one
    assert {r.path for r in S.orphans(paths, loaded, one("p/e.py")).collect()} == {"p/b.txt", "p/c.md", "q/d.txt", "h.txt"}
