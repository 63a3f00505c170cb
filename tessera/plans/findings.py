"""Queries over findings: normalising, scoring, merging, comparing with a baseline.

Line items stand for findings (part: file, line number: line, return flag: report, line status and ship month: type, order priority: severity).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalogue import spec
from tessera.functions import scoring as S
from tessera.operators import dedupe as D
from tessera.operators import joins as J

#: Order priorities as severities; fixed for the queries.
PRIORITY = {"1-URGENT": "HIGH ", "2-HIGH": "high", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "", "5-LOW": "low"}
RAW_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY.items()) + " END"
SEV_SQL = f"CASE WHEN lower(trim({RAW_SQL})) IN ('high', 'medium', 'low') THEN lower(trim({RAW_SQL})) ELSE 'medium' END"
WEIGHT_SQL = f"CASE {SEV_SQL} WHEN 'high' THEN 10 WHEN 'low' THEN 1 ELSE 3 END"
#: Categories of line status and return flag; null: unmapped.
CATEGORY = {"OA": "security", "OR": "tests", "ON": "complexity", "FA": "correctness", "FR": "design"}
CATEGORY_SQL = "CASE l_linestatus || l_returnflag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY.items()) + f" ELSE '{S.FALLBACK}' END"
RUBRIC_SQL = "r(category, weight, half_life) AS (VALUES " + ", ".join(f"('{k}', {w}, {h})" for k, (w, h) in S.CATEGORIES.items()) + ")"


def raw_severity():
    made = None
    for k, v in PRIORITY.items():
        made = F.when(F.col("o_orderpriority") == k, v) if made is None else made.when(F.col("o_orderpriority") == k, v)
    return made


def category():
    key, made = F.concat("l_linestatus", "l_returnflag"), None
    for k, v in CATEGORY.items():
        made = F.when(key == k, v) if made is None else made.when(key == k, v)
    return made.otherwise(S.FALLBACK)


@spec("severity_normalize", f"SELECT o_orderkey, {SEV_SQL} AS severity, {WEIGHT_SQL} AS weight FROM orders")
def severity_normalize(t):
    return t.orders.select("o_orderkey", S.severity(raw_severity()).alias("severity"), S.severity_weight(raw_severity()).alias("weight"))


@spec("categorize_findings", f"SELECT l_orderkey, l_linenumber, {CATEGORY_SQL} AS category, l_linestatus || l_returnflag IN ({', '.join(f"'{k}'" for k in CATEGORY)}) AS matched FROM lineitem")
def categorize_findings(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", category().alias("category"), F.concat("l_linestatus", "l_returnflag").isin(*CATEGORY).alias("matched"))


@spec("unmapped_types", f"SELECT l_linestatus || l_returnflag AS type, count(*) AS n FROM lineitem WHERE l_linestatus || l_returnflag NOT IN ({', '.join(f"'{k}'" for k in CATEGORY)}) GROUP BY 1")
def unmapped_types(t):
    kind = F.concat("l_linestatus", "l_returnflag")
    return t.lineitem.where(~kind.isin(*CATEGORY)).groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


@spec("summary_by_severity_category", f"SELECT o_orderstatus AS category, count(*) FILTER ({SEV_SQL} = 'high') AS high, count(*) FILTER ({SEV_SQL} = 'medium') AS medium, count(*) FILTER ({SEV_SQL} = 'low') AS low, count(*) AS total FROM orders GROUP BY 1")
def summary_by_severity_category(t):
    s = S.severity(raw_severity())
    return t.orders.groupBy(F.col("o_orderstatus").alias("category")).agg(*(F.count_if(s == k).alias(k) for k in S.SEVERITIES), F.count("*").alias("total"))


SCORES_SQL = f"""{RUBRIC_SQL}, n AS (SELECT {CATEGORY_SQL} AS category, count(*) AS findings, sum({WEIGHT_SQL}) AS weighted FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
z AS (SELECT sum(n_chars) AS loc FROM documents),
s AS (SELECT category, weight, coalesce(findings, 0) AS findings, coalesce(weighted, 0)::BIGINT AS weighted, round(coalesce(weighted, 0) / greatest(loc, 1000) * 1000, 2) AS density,
  round(CASE WHEN coalesce(weighted, 0) = 0 THEN 100.0 ELSE 100 * pow(0.5, coalesce(weighted, 0) / greatest(loc, 1000) * 1000 / half_life) END, 1) AS score FROM r LEFT JOIN n USING (category), z)"""


def scores(t):
    spark = t.spark
    rubric = F.broadcast(spark.createDataFrame([(k, w, h) for k, (w, h) in S.CATEGORIES.items()], "category string, weight int, half_life int"))
    found = t.lineitem.select("l_orderkey", category().alias("category")).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), S.severity_weight(raw_severity()).alias("w")), "l_orderkey")
    counts = found.groupBy("category").agg(F.count("*").alias("findings"), F.sum("w").alias("weighted"))
    loc = t.documents.agg(F.sum("n_chars").alias("loc"))
    made = rubric.join(counts, "category", "left").crossJoin(F.broadcast(loc)).na.fill(0, ["findings", "weighted"])  # one row each way
    d = S.density(F.col("weighted"), F.col("loc"))
    return made.select("category", "weight", "findings", "weighted", F.round(d, 2).alias("density"), F.round(S.score(d, F.col("half_life")), 1).alias("score"))


@spec("category_scores", f"WITH {SCORES_SQL} SELECT *, {S.grade_sql('score')} AS grade FROM s")
def category_scores(t):
    return scores(t).withColumn("grade", S.grade(F.col("score")))


@spec("overall_grade", f"WITH {SCORES_SQL}, o AS (SELECT round(sum(weight * score) / sum(weight), 1) AS overall FROM s) SELECT overall, {S.grade_sql('overall')} AS grade FROM o")
def overall_grade(t):
    return scores(t).agg(F.round(S.weighted_mean(F.col("score"), F.col("weight")), 1).alias("overall")).withColumn("grade", S.grade(F.col("overall")))


@spec("grade_ungraded_dropped", f"""WITH g AS (SELECT o_custkey AS package, o_orderstatus AS category, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice % 100 END AS score, 1 + o_orderkey % 4 AS weight FROM orders),
p AS (SELECT package, round(sum(weight * score) / sum(CASE WHEN score IS NOT NULL THEN weight END), 1) AS overall, count(*) FILTER (score IS NULL) AS ungraded FROM g GROUP BY package) SELECT *, {S.grade_sql('overall')} AS grade FROM p""")
def grade_ungraded_dropped(t):
    g = t.orders.select(F.col("o_custkey").alias("package"), F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_totalprice") % 100).alias("score"), (1 + F.col("o_orderkey") % 4).alias("weight"))
    by = g.groupBy("package").agg(F.round(S.weighted_mean(F.col("score"), F.col("weight")), 1).alias("overall"), F.count_if(F.col("score").isNull()).alias("ungraded"))
    return by.withColumn("grade", S.grade(F.col("overall")))


@spec("importance_weighted_score", """WITH i AS (SELECT 1 + o_orderkey % 3 AS importance, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0 END AS credit FROM orders)
SELECT importance, 100 * sum(importance * credit)::DOUBLE / sum(importance) AS share, count(*) AS n FROM i GROUP BY GROUPING SETS ((importance), ())""")
def importance_weighted_score(t):
    k = F.col("o_orderkey") % 4
    i = t.orders.select((1 + F.col("o_orderkey") % 3).alias("importance"), F.when(k == 0, 1.0).when(k == 1, 0.5).when(k == 2, 0.25).otherwise(0.0).alias("credit")).withColumn("part", F.col("importance") * F.col("credit"))
    return i.rollup("importance").agg((100 * F.sum("part") / F.sum(i["importance"])).alias("share"), F.count("*").alias("n"))


FINDINGS_SQL = f"f AS (SELECT l_returnflag AS report, l_partkey AS file, l_linenumber AS line, l_linestatus AS type, {SEV_SQL} AS severity, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS ordinal FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def as_findings(t):
    sev = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), S.severity(raw_severity()).alias("severity"))
    rows = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("report"), F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("type"))
    return rows.join(sev, "l_orderkey").select("report", "file", "line", "type", "severity", ((F.col("l_orderkey") * 10 + F.col("line")) * 100000 + F.col("l_suppkey")).alias("ordinal"))


@spec("cross_report_dedupe", f"""WITH {FINDINGS_SQL}, g AS (SELECT report, file, line, type, count(*) AS n, min(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS worst, min(ordinal) AS first FROM f GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY file, line, type ORDER BY n DESC, worst, report) AS place, first_value(report) OVER w AS first_report, first_value(first) OVER w AS first_seen FROM g WINDOW w AS (PARTITION BY file, line, type ORDER BY report))
SELECT f.*, first_report, first_seen FROM f JOIN b USING (report, file, line, type) WHERE place = 1""")
def cross_report_dedupe(t):
    """Reports come in the order of their names; on equal terms the earlier one's call stays."""
    made = D.max_multiplicity(as_findings(t))
    return made.select("report", "file", "line", "type", "severity", "ordinal", F.col("first_seen.report").alias("first_report"), F.col("first_seen.ordinal").alias("first_seen"))


@spec("union_attributed", "SELECT 'lines' AS doctor, l_partkey AS file, l_linenumber AS line FROM lineitem UNION ALL SELECT 'orders', o_custkey, 0 FROM orders")
def union_attributed(t):
    lines = t.lineitem.select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"))
    return D.attributed({"lines": lines, "orders": t.orders.select(F.col("o_custkey").alias("file"), F.lit(0).alias("line"))}).select("doctor", "file", "line")


@spec("bag_anti_baseline", "SELECT l_partkey AS file, l_linestatus AS type FROM lineitem WHERE l_returnflag <> 'A' EXCEPT ALL SELECT l_partkey, l_linestatus FROM lineitem WHERE l_returnflag = 'A'")
def bag_anti_baseline(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("file"), F.col("l_linestatus").alias("type"), "l_returnflag", "l_orderkey", "l_linenumber")
    return J.bag_anti_join(rows.where("l_returnflag != 'A'"), rows.where("l_returnflag = 'A'"), ["file", "type"], ["l_orderkey", "l_linenumber"]).select("file", "type")


@spec("range_join_defs", """WITH s AS (SELECT o_custkey AS file, o_orderkey AS def, (o_orderkey % 50) * 10 AS a, (o_orderkey % 50) * 10 + 25 AS b FROM orders), p AS (SELECT event_id, user_id AS file, event_id % 500 AS line FROM events)
SELECT event_id, def FROM p JOIN s ON p.file = s.file AND line BETWEEN a AND b""")
def range_join_defs(t):
    k = F.col("o_orderkey") % 50 * 10
    s = t.orders.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("def"), k.alias("a"), (k + 25).alias("b"))
    p = t.events.select("event_id", F.col("user_id").alias("file"), (F.col("event_id") % 500).alias("line"))
    return J.range_join(p, s, "file", "line", "a", "b").select("event_id", "def")


@spec("line_mapper", """WITH h AS (SELECT o_custkey AS file, o_orderkey % 1000 AS new_start, 1 + o_orderkey % 5 AS new_count, o_orderkey % 3 AS old_count FROM orders),
p AS (SELECT event_id, user_id AS file, event_id % 1000 AS line FROM events)
SELECT event_id, CASE WHEN coalesce(bool_or(line >= new_start AND line < new_start + new_count), false) THEN NULL ELSE line - coalesce(sum(new_count - old_count) FILTER (new_start + new_count <= line), 0)::BIGINT END AS base_line
FROM p LEFT JOIN h USING (file) GROUP BY event_id, line""")
def line_mapper(t):
    """Hunks' ends and events in one order by line: running sums and greatest ends, no join of events with hunks."""
    h = t.orders.select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 1000).alias("s"), (1 + F.col("o_orderkey") % 5).alias("n"), (F.col("o_orderkey") % 3).alias("old"))
    p = t.events.select("event_id", F.col("user_id").alias("file"), (F.col("event_id") % 1000).alias("line"))
    return J.map_lines(p, h, "event_id")


@spec("semi_related_lines", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = l_orderkey % 200 AND e.event_id % 7 IN (l_linenumber, l_linenumber + 1))")
def semi_related_lines(t):
    changed = t.events.select(F.col("user_id").alias("k"), F.explode(F.array(F.col("event_id") % 7, F.col("event_id") % 7 - 1)).alias("line")).distinct()
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 200).alias("k"), F.col("l_linenumber").cast("long").alias("line"))
    return rows.join(changed, ["k", "line"], "left_semi").select("l_orderkey", "l_linenumber")


@spec("full_outer_signature_diff", """WITH a AS (SELECT o_custkey, max(o_orderstatus) AS old FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1), b AS (SELECT o_custkey, max(o_orderstatus) AS new FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT o_custkey, old, new, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'deleted' WHEN old = new THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_custkey)""")
def full_outer_signature_diff(t):
    a = t.orders.where("o_orderdate < timestamp '1995-01-01'").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("old"))
    b = t.orders.where("o_orderdate >= timestamp '1997-01-01'").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("new"))
    return a.join(b, "o_custkey", "full").withColumn("change", F.expr("CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'deleted' WHEN old = new THEN 'same' ELSE 'changed' END"))


@spec("top_findings", f"WITH {FINDINGS_SQL} SELECT report, file, line, type, severity, ordinal FROM f ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, file, line, ordinal LIMIT 25")
def top_findings(t):
    return as_findings(t).orderBy(S.severity_rank(F.col("severity")), "file", "line", "ordinal").limit(25)  # the feature is a top 25


@spec("anti_declared_imports", "SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def anti_declared_imports(t):
    return t.part.select("p_partkey").distinct().join(t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@spec("anti_unused_exports", """SELECT s_suppkey, s_nationkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09 AND l_quantity >= 49 AND l_linenumber = 1) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
def anti_unused_exports(t):
    s = t.supplier.select("s_suppkey", "s_nationkey")
    used = t.lineitem.where("l_discount > 0.09 AND l_quantity >= 49 AND l_linenumber = 1").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(used, "s_suppkey", "left_anti").join(t.nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_anti").select("s_suppkey", "s_nationkey")


@spec("glob_theta_join", "WITH g(pattern) AS (VALUES ('%a%1'), ('%2'), ('%red%')), m AS (SELECT pattern, p_partkey, row_number() OVER (PARTITION BY pattern ORDER BY p_partkey) AS n FROM part JOIN g ON p_name LIKE pattern) SELECT pattern, p_partkey FROM m WHERE n <= 25")
def glob_theta_join(t):
    patterns = ["%a%1", "%2", "%red%"]
    hits = F.filter(F.array(*(F.when(F.col("p_name").like(p), F.lit(p)) for p in patterns)), lambda x: x.isNotNull())
    m = t.part.select("p_partkey", F.explode(hits).alias("pattern"))
    return m.withColumn("n", F.row_number().over(Window.partitionBy("pattern").orderBy("p_partkey"))).where("n <= 25").select("pattern", "p_partkey")  # the feature is a cap of 25


@spec("version_window_severity", """WITH c(change, deprecated, removed) AS (VALUES ('a', 5, 10), ('b', 12, 20), ('c', 30, 40), ('d', 45, NULL))
SELECT p_partkey, change, CASE WHEN removed <= p_size THEN 'high' WHEN deprecated <= p_size THEN 'medium' ELSE 'low' END AS severity FROM part JOIN c ON deprecated <= p_size""")
def version_window_severity(t):
    c = t.spark.createDataFrame([("a", 5, 10), ("b", 12, 20), ("c", 30, 40), ("d", 45, None)], "change string, deprecated int, removed int")
    made = t.part.join(F.broadcast(c), F.col("deprecated") <= F.col("p_size"))  # a rule table of fixed size
    return made.select("p_partkey", "change", F.expr("CASE WHEN removed <= p_size THEN 'high' WHEN deprecated <= p_size THEN 'medium' ELSE 'low' END").alias("severity"))
