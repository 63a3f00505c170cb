"""Queries over dependency graphs and groups.  Nations stand for modules; an order from a customer's to a supplier's nation is an edge."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalogue import spec
from tessera.operators import graph as G

ALL_SQL = """w AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"""
EDGES_SQL = f"""{ALL_SQL},
e AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM w WHERE src <> dst) WHERE n <= 2)"""


def all_edges(t):
    """Every pair of different modules with what lies between them."""
    li = t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey")
    o = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.count("*").alias("weight")).where("src != dst")


def edges(t):
    """Each module's two heaviest edges: a sparser graph for the queries on paths and cycles, where the whole one, which is complete, has one answer for all."""
    return all_edges(t).withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))).where("n <= 2").select("src", "dst", "weight")


@spec("module_edges", f"WITH {ALL_SQL} SELECT * FROM w WHERE src <> dst")
def module_edges(t):
    return all_edges(t)


@spec("fan_in_out", f"WITH {ALL_SQL}, e AS (SELECT * FROM w WHERE src <> dst), x AS (SELECT src AS vertex, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) SELECT vertex, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM x GROUP BY 1")
def fan_in_out(t):
    return G.fans(all_edges(t))


@spec("reachability", f"WITH RECURSIVE {EDGES_SQL}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r")
def reachability(t):
    return G.closure(edges(t)).select("src", "dst")


@spec("scc", f"""WITH RECURSIVE {EDGES_SQL}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
m AS (SELECT a.src AS vertex, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)
SELECT vertex, component, count(*) OVER (PARTITION BY component) AS size FROM m""")
def scc(t):
    found = G.components(edges(t))
    least = found.groupBy("component").agg(F.min("vertex").alias("least"))
    return found.join(least, "component").select("vertex", F.col("least").alias("component"), "size")


@spec("ancestors_depth", f"""WITH RECURSIVE {EDGES_SQL}, d AS (SELECT src, dst FROM e WHERE src < dst), r(src, dst, depth) AS (SELECT src, dst, 1 FROM d UNION SELECT r.src, d.dst, depth + 1 FROM r JOIN d ON d.src = r.dst)
SELECT src, dst, min(depth) AS depth FROM r GROUP BY ALL""")
def ancestors_depth(t):
    return G.closure(edges(t).where("src < dst"))


@spec("lump_other", """WITH m AS (SELECT p_brand AS module, sum(p_size) AS loc, row_number() OVER (ORDER BY sum(p_size) DESC, p_brand) AS n FROM part GROUP BY 1)
SELECT CASE WHEN n <= 9 THEN module ELSE '(other)' END AS module, sum(loc)::BIGINT AS loc FROM m GROUP BY 1""")
def lump_other(t):
    m = t.part.groupBy(F.col("p_brand").alias("module")).agg(F.sum("p_size").alias("loc"))
    top = m.orderBy(F.desc("loc"), "module").limit(9).select(F.col("module").alias("kept"))  # the feature is a top 9
    return m.join(F.broadcast(top), F.col("module") == F.col("kept"), "left").groupBy(F.coalesce("kept", F.lit("(other)")).alias("module")).agg(F.sum("loc").alias("loc"))


@spec("data_clumps", """WITH g AS (SELECT DISTINCT l_orderkey, l_suppkey % 40 AS p FROM lineitem), q AS (SELECT * FROM g)
SELECT a.p AS a, b.p AS b, c.p AS c, count(*) AS functions FROM q a JOIN q b ON a.l_orderkey = b.l_orderkey AND a.p < b.p JOIN q c ON c.l_orderkey = b.l_orderkey AND b.p < c.p GROUP BY ALL HAVING count(*) >= 3""")
def data_clumps(t):
    """Each function's parameters are one sorted array (as long as a parameter list), whose 3-subsets are made in the row: one shuffle, no self-joins."""
    g = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_suppkey") % 40)).alias("p")).where(F.size("p") >= 3)
    at = lambda i: F.get("p", i)
    last = F.size("p") - 1
    triples = F.flatten(F.transform(F.sequence(F.lit(0), last - 2), lambda i: F.flatten(F.transform(F.sequence(i + 1, last - 1), lambda j: F.transform(F.sequence(j + 1, last), lambda k: F.struct(at(i).alias("a"), at(j).alias("b"), at(k).alias("c")))))))
    return g.select(F.explode(triples).alias("x")).groupBy("x.a", "x.b", "x.c").agg(F.count("*").alias("functions")).where("functions >= 3")


@spec("lcom_pairs", """WITH m AS (SELECT l_orderkey AS class, l_linenumber AS method, list_distinct(list(l_suppkey % 5)) AS attrs FROM lineitem GROUP BY ALL)
SELECT a.class, sum(CASE WHEN list_has_any(a.attrs, b.attrs) THEN -1 ELSE 1 END)::BIGINT AS lcom, count(*) AS pairs FROM m a JOIN m b ON a.class = b.class AND a.method < b.method GROUP BY a.class""")
def lcom_pairs(t):
    """A class's methods are one array of attribute sets, whose pairs are counted in the row: one shuffle of narrow rows, no self-join."""
    m = t.lineitem.groupBy(F.col("l_orderkey").alias("class"), F.col("l_linenumber").alias("method")).agg(F.collect_set(F.col("l_suppkey") % 5).alias("attrs"))
    c = m.groupBy("class").agg(F.collect_list("attrs").alias("sets")).where(F.size("sets") > 1)
    later = lambda i: F.slice("sets", i + 2, F.size("sets"))
    each = F.transform("sets", lambda x, i: F.aggregate(later(i), F.lit(0), lambda n, y: n + F.when(F.arrays_overlap(x, y), -1).otherwise(1)))
    k = F.size("sets").cast("long")
    return c.select("class", F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b).alias("lcom"), (k * (k - 1) / 2).cast("long").alias("pairs"))


@spec("single_implementation", "SELECT n_nationkey, n_name, count(s_suppkey) AS implementations FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL HAVING count(s_suppkey) <= 2")
def single_implementation(t):
    by = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("implementations"))
    return t.nation.select("n_nationkey", "n_name").join(by, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("implementations", F.lit(0)).alias("implementations")).where("implementations <= 2")
