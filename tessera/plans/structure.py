"""Queries over classes, types, regions and assets.  Orders stand for classes and types, their items for methods and members."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import spec
from tessera.functions import paths as P
from tessera.operators import structure as S
from tessera.plans.repository import FILES_SQL, SOURCE_SQL, files


@spec("low_cohesion", """WITH m AS (SELECT l_orderkey AS class, l_linenumber AS method, list_distinct(flatten(list(CASE WHEN l_quantity < 8 THEN [] ELSE [l_suppkey % 9, l_partkey % 9] END))) AS own FROM lineitem GROUP BY ALL),
c AS (SELECT class FROM m GROUP BY class HAVING count(*) >= 4 AND len(list_distinct(flatten(list(own)))) >= 2),
p AS (SELECT a.class, count(*) FILTER (NOT list_has_any(a.own, b.own)) AS disjoint, count(*) AS pairs FROM m a JOIN m b ON a.class = b.class AND a.method < b.method WHERE a.class IN (SELECT class FROM c) GROUP BY a.class)
SELECT p.*, (SELECT count(*) FROM m WHERE m.class = p.class AND len(own) = 0)::INT AS loners, CASE WHEN disjoint / pairs < 0.95 THEN 'medium' ELSE 'high' END AS severity FROM p WHERE disjoint / pairs >= 0.8""")
def low_cohesion(t):
    fields = F.when(F.col("l_quantity") < 8, F.array(F.lit(None).cast("long"))).otherwise(F.array(F.col("l_suppkey") % 9, F.col("l_partkey") % 9))
    return S.low_cohesion(t.lineitem.select(F.col("l_orderkey").alias("class"), F.col("l_linenumber").alias("method"), F.explode(fields).alias("field")))


@spec("feature_envy", """WITH a AS (SELECT user_id % 40 AS class, event_type AS method, CASE WHEN event_id % 7 < 2 THEN NULL ELSE 'o' || event_id % 7 % 3 END AS object, event_id % 2 AS member FROM events),
o AS (SELECT class, method, object, count(*) AS n, count(DISTINCT member) AS members FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY class, method ORDER BY n DESC, object) AS k FROM o WHERE object IS NOT NULL),
j AS (SELECT r.class, r.method, r.object AS envied, r.n AS touches, coalesce(o.members, 0) AS own FROM r LEFT JOIN o ON o.class = r.class AND o.method = r.method AND o.object IS NULL WHERE k = 1)
SELECT * FROM j WHERE touches >= 4 AND touches > 2 * greatest(own, 1)""")
def feature_envy(t):
    e = F.col("event_id")
    other = F.when(e % 7 >= 2, F.concat(F.lit("o"), (e % 7 % 3).cast("string")))
    return S.feature_envy(t.events.select((F.col("user_id") % 40).alias("class"), F.col("event_type").alias("method"), other.alias("object"), (e % 2).alias("member")))


@spec("same_shapes", """WITH m AS (SELECT l_orderkey AS ordinal, 'T' || l_orderkey % 11 AS name, list_sort(list('m' || l_linenumber || ':' || 'Map<' || l_returnflag || ',' || l_linestatus || '>')) AS members FROM lineitem GROUP BY ALL),
s AS (SELECT ordinal, name, array_to_string(members, '|') AS shape FROM m WHERE len(members) >= 3)
SELECT shape, arg_min(name, ordinal) AS first, count(*) AS occurrences FROM s GROUP BY shape HAVING count(DISTINCT name) > 1""")
def same_shapes(t):
    member = F.struct(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("name"), F.concat(F.lit("Map< "), "l_returnflag", F.lit(", "), "l_linestatus", F.lit(">")).alias("type"))
    types = t.lineitem.groupBy(F.col("l_orderkey").alias("ordinal")).agg(F.collect_list(member).alias("members"))
    return S.same_shapes(types.withColumn("name", F.concat(F.lit("T"), (F.col("ordinal") % 11).cast("string"))))


@spec("regions", """WITH g AS (SELECT event_type AS digest, user_id % 20 AS file, list_sort(list(event_id)) AS lines FROM events GROUP BY ALL)
SELECT digest, file, unnest(list_reduce(list_transform(lines, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 50 THEN list_concat(a, x) ELSE a END)) AS line FROM g""")
def regions(t):
    hits = t.events.groupBy(F.col("event_type").alias("digest"), (F.col("user_id") % 20).alias("file")).agg(F.collect_list("event_id").alias("lines"))
    return hits.select("digest", "file", F.explode(S.regions(F.col("lines"))).alias("line"))


@spec("orphans", f"""WITH {FILES_SQL}, s AS (SELECT DISTINCT path FROM n WHERE {SOURCE_SQL}), r AS (SELECT DISTINCT path FROM n WHERE id % 7 = 0),
a AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, CASE WHEN path LIKE '%.%' THEN regexp_extract(path, '[^.]*$') END AS ending FROM r WHERE path NOT IN (SELECT path FROM s))
SELECT DISTINCT path FROM n WHERE path LIKE '%.%' AND path NOT LIKE '.%' AND path NOT IN (SELECT path FROM s) AND path NOT IN (SELECT path FROM r)
AND regexp_replace(path, '/[^/]*$', '') IN (SELECT dir FROM a) AND regexp_extract(path, '[^.]*$') IN (SELECT ending FROM a WHERE ending IS NOT NULL)""")
def orphans(t):
    f = files(t)
    source = P.is_source(F.col("path"))
    return S.orphans(f.select("path"), f.where("id % 7 = 0").select("path", (~source).alias("asset")), f.where(source).select("path"))
