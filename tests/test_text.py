"""Lines, branches and indents on hand-worked cases, and joins on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dedupe as D
from tessera.operators import graph as G
from tessera.operators import joins as J

CASES = [
    # text, lines with anything, branches, deepest indent
    ("", 0, 0, 0), ("\n\t\n  \n", 0, 0, 0), ("x", 1, 0, 0), ("\t# if x\n\t\n  if a:\n    # for y", 3, 1, 0), ("a ? b : c", 1, 1, 0), ("unless x until y", 1, 0, 0), ("a ?\nb", 2, 0, 0),
    ("if a:\n    for b in c:\n        while d and e || f:\n", 3, 4, 2), ("else if x { }", 1, 1, 0), ("elif_x = 1\niffy\nnaïf élif", 3, 0, 0), ("\tif a\n\t\tif b", 2, 2, 2), ("\t    if a", 1, 1, 1),
    ("// if\n * if\n/* if\n-- if\n\"\"\"if\n'''if\n#if", 7, 0, 0), ("if a\r\nif b\rif c", 3, 3, 0), (" " * 60 + "x", 1, 0, 12), ("\u00a0\u2003\nx\u2028if", 2, 1, 0), ("a && b", 1, 1, 0), ("match x\ncase y\nswitch z catch rescue except when", 3, 7, 0),
]


def test_lines_branches_and_indents(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(99, None)], "i int, text string")
    got = {r["i"]: (r["loc"], r["branches"], r["depth"]) for r in rows.select("i", T.loc(F.col("text")).alias("loc"), T.branches(F.col("text")).alias("branches"), T.max_indent(F.col("text")).alias("depth")).collect()}
    assert {k: (CASES[k], v) for k, v in got.items() if k != 99 and v != CASES[k][1:]} == {} and got[99] == (0, 0, 0)


def test_the_earlier_report_wins_on_equal_terms(spark):
    rows = [("b", 1, 1, "x", "high", 1), ("a", 1, 1, "x", "high", 9), ("a", 2, 1, "x", "low", 2), ("b", 2, 1, "x", "high", 3), ("a", 3, 1, "x", "low", 4), ("b", 3, 1, "x", "low", 5), ("b", 3, 1, "x", "low", 6), ("a", None, 1, "x", None, 7), ("a", None, 1, "x", None, 8)]
    got = D.max_multiplicity(spark.createDataFrame(rows, "report string, file int, line int, type string, severity string, ordinal int")).collect()
    assert sorted((r["report"], r["file"] or 0, r["ordinal"]) for r in got) == [("a", 0, 7), ("a", 0, 8), ("a", 1, 9), ("b", 2, 3), ("b", 3, 5), ("b", 3, 6)]
    assert {r["file"]: (r["first_seen"]["report"], r["first_seen"]["ordinal"]) for r in got} == {None: ("a", 7), 1: ("a", 9), 2: ("a", 2), 3: ("a", 4)}


def test_lines_before_hunks(spark):
    hunks = [("f", 10, 3, 1), ("f", 20, 1, 4), ("g", 1, 2, 0)]
    points = [(i, f, line) for i, (f, line) in enumerate((f, n) for f in "fgh" for n in range(1, 30))]
    got = {r["i"]: r["base_line"] for r in J.map_lines(spark.createDataFrame(points, "i int, file string, line long"), spark.createDataFrame(hunks, "file string, s long, n long, old long"), "i").collect()}
    for i, f, line in points:
        own = [h for h in hunks if h[0] == f]
        want = None if any(s <= line < s + n for _, s, n, _ in own) else line - sum(n - old for _, s, n, old in own if s + n <= line)
        assert got[i] == want


@pytest.mark.parametrize("in_row", [20_000, 0])
def test_items_are_found_wherever_they_stand(spark, monkeypatch, in_row):
    monkeypatch.setattr(J, "IN_ROW", in_row)
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "cd", "ef", "g"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 9)))) for i in range(30)] + [(90, "x\ny  z a b c d"), (91, "")]
    docs = [(i, "".join(word() + rng.choice([" ", " ", "\n", ""]) for _ in range(40))) for i in range(30)] + [(80, f"pre{items[4][1]}post"), (81, "in x\ny  z a b c de"), (82, None), (83, "")]
    got = sorted(tuple(r) for r in J.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string")).collect())
    assert got == sorted((d, i) for d, t in docs for i, x in items if t is not None and x in t)


def test_long_chains_are_followed_to_their_ends(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "src int, dst int")
    assert G.closure(chain).count() == 70 * 71 // 2
    assert G.closure(chain, 3).agg(F.max("depth")).first()[0] == 3
