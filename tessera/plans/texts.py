"""Queries over source text: size and branches, hotspots, inventories, duplicates, matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalogue import spec
from tessera.functions import text as T
from tessera.operators import graph as G
from tessera.operators import joins as J

#: Line by line: the reference's own way, written out for DuckDB (whose word bounds see ASCII letters only, so accented ones become z).
BLANK_SQL = T.BLANK
TRIM_SQL = f"regexp_replace(regexp_replace(line, '^{BLANK_SQL}+', ''), '{BLANK_SQL}+$', '')"
COMMENT_SQL = "^(" + T.COMMENT[1:-1].replace("\\'", "''").replace('\\"', '"') + ")"
LETTER_SQL = "regexp_replace(line, '[À-ÖØ-öø-ɏ]', 'z', 'g')"
BRANCHES_SQL = f"len(regexp_extract_all({LETTER_SQL}, '{T.BRANCH.replace(chr(92) + 's', T.BLANK)}'))"
#: A document's lines, its lines with text, and its branches.
LINES_SQL = f"l AS (SELECT doc_id, lang, source, unnest(string_split(regexp_replace(text, '{T.LINE_END}', chr(10), 'g'), chr(10))) AS line FROM documents WHERE text <> '')"
METRICS_SQL = f"""s AS (SELECT *, {TRIM_SQL} AS bare FROM l), m AS (SELECT d.doc_id, d.lang, d.source, count(*) FILTER (bare <> '') AS loc,
  coalesce(sum({BRANCHES_SQL}) FILTER (NOT regexp_matches(bare, '{COMMENT_SQL}')), 0) AS branches,
  coalesce(max(least(CASE WHEN i LIKE '% %' THEN length(i) // 4 ELSE length(i) END, 12)) FILTER (bare <> '' AND NOT regexp_matches(bare, '{COMMENT_SQL}')), 0) AS depth
  FROM documents d LEFT JOIN (SELECT *, regexp_extract(line, '^[ \\t]*') AS i FROM s) s USING (doc_id) GROUP BY ALL)"""


def metrics(t):
    return t.documents.select("doc_id", "lang", "source", T.loc(F.col("text")).alias("loc"), T.branches(F.col("text")).alias("branches"), T.max_indent(F.col("text")).alias("depth"))


def churn(t):
    """Events stand for commits: each touches the document that its number and its user's lead to."""
    return t.events.groupBy((F.col("event_id") * 31 % 7919 + F.col("user_id") * 7 % 100).alias("doc_id")).agg(F.count("*").alias("churn"), F.countDistinct("event_type").alias("authors"))


@spec("loc_complexity", f"WITH {LINES_SQL}, {METRICS_SQL} SELECT doc_id, loc, branches::BIGINT AS branches, depth::BIGINT AS depth FROM m")
def loc_complexity(t):
    return metrics(t).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("loc", "branches", "depth")))


@spec("doc_hotspots", f"""WITH {LINES_SQL}, {METRICS_SQL}, c AS (SELECT event_id * 31 % 7919 + user_id * 7 % 100 AS doc_id, count(*) AS churn, count(DISTINCT event_type) AS authors FROM events GROUP BY 1)
SELECT m.doc_id, loc, branches::BIGINT AS branches, coalesce(churn, 0) AS churn, coalesce(authors, 0) AS authors, (coalesce(churn, 0) * (branches + 1))::BIGINT AS score
FROM m LEFT JOIN c USING (doc_id) WHERE loc > 0 ORDER BY score DESC, doc_id LIMIT 60""")
def doc_hotspots(t):
    both = metrics(t).where("loc > 0").join(churn(t), "doc_id", "left").na.fill(0, ["churn", "authors"])
    ranked = both.select("doc_id", F.col("loc").cast("long").alias("loc"), F.col("branches").cast("long").alias("branches"), "churn", "authors", (F.col("churn") * (F.col("branches") + 1)).alias("score"))
    return ranked.orderBy(F.desc("score"), "doc_id").limit(60)  # the feature is a top 60


@spec("dormant_complex", f"""WITH {LINES_SQL}, {METRICS_SQL}, c AS (SELECT DISTINCT event_id * 31 % 7919 + user_id * 7 % 100 AS doc_id FROM events)
SELECT doc_id, branches::BIGINT AS branches FROM m ANTI JOIN c USING (doc_id) WHERE branches > 3 ORDER BY branches DESC, doc_id LIMIT 8""")
def dormant_complex(t):
    return metrics(t).where("branches > 3").join(churn(t), "doc_id", "left_anti").select("doc_id", F.col("branches").cast("long").alias("branches")).orderBy(F.desc("branches"), "doc_id").limit(8)


@spec("inventory_by_lang", f"WITH {LINES_SQL}, {METRICS_SQL} SELECT lang, count(*) AS files, sum(loc)::BIGINT AS loc, sum(loc) / sum(sum(loc)) OVER () AS share FROM m GROUP BY lang")
def inventory_by_lang(t):
    by = metrics(t).groupBy("lang").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("loc").alias("total")))).select("lang", "files", "loc", (F.col("loc") / F.col("total")).alias("share"))


@spec("dominant_language", f"""WITH {LINES_SQL}, {METRICS_SQL}, g AS (SELECT source, lang, sum(loc) AS loc FROM m GROUP BY ALL)
SELECT source, lang, loc::BIGINT AS loc, loc / sum(loc) OVER (PARTITION BY source) AS share, row_number() OVER (PARTITION BY source ORDER BY loc DESC, lang) = 1 AS dominant FROM g
QUALIFY dominant OR share >= 0.2""")
def dominant_language(t):
    by = metrics(t).groupBy("source", "lang").agg(F.sum("loc").alias("loc"))
    w = Window.partitionBy("source")
    made = by.withColumn("share", F.col("loc") / F.sum("loc").over(w)).withColumn("dominant", F.row_number().over(w.orderBy(F.desc("loc"), "lang")) == 1)
    return made.where("dominant or share >= 0.2")


PATHS_SQL = "f AS (SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id % 10 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, n_chars AS loc FROM documents)"


def paths(t):
    return t.documents.select("doc_id", F.concat_ws("/", "source", "lang", (F.col("doc_id") % 10).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("n_chars").alias("loc"))


@spec("dir_rollup", f"""WITH {PATHS_SQL}, x AS (SELECT string_split(path, '/') AS p, loc FROM f), e AS (SELECT p, loc, unnest(range(0, len(p))) AS n FROM x)
SELECT array_to_string(p[1:n], '/') AS dir, sum(CASE WHEN n = len(p) - 1 THEN loc ELSE 0 END)::BIGINT AS own_loc, sum(loc)::BIGINT AS subtree_loc, count(*) AS files FROM e GROUP BY 1""")
def dir_rollup(t):
    return G.dir_rollup(paths(t))


@spec("module_assignment", f"""WITH {PATHS_SQL}, m AS (SELECT DISTINCT source AS prefix FROM documents UNION SELECT DISTINCT source || '/en' FROM documents WHERE lang = 'en')
SELECT doc_id, path, max_by(prefix, length(prefix)) AS module FROM f JOIN m ON path LIKE prefix || '/%' GROUP BY ALL""")
def module_assignment(t):
    modules = t.documents.select(F.col("source").alias("prefix")).union(t.documents.where("lang = 'en'").select(F.concat("source", F.lit("/en")))).distinct()
    return J.longest_prefix_join(paths(t).select("doc_id", "path"), modules).withColumnRenamed("matched", "module").select("doc_id", "path", "module")


@spec("exact_duplicates", """SELECT substr(sha256(regexp_replace(lower(trim(text)), '[ \\t\\n\\r]+', ' ', 'g')), 1, 12) AS digest, count(*) AS copies, min(doc_id) AS first_id, avg(n_chars) AS avg_chars
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(t):
    norm = F.regexp_replace(F.lower(F.trim(F.col("text"))), "[ \t\n\r]+", " ")
    return t.documents.groupBy(F.substring(F.sha2(norm, 256), 1, 12).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.avg("n_chars").alias("avg_chars")).where("copies > 1")


@spec("repeated_literals", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(*) AS uses, count(DISTINCT doc_id) AS files FROM l WHERE length(trim(line)) >= 8 GROUP BY line HAVING count(*) >= 5""")
def repeated_literals(t):
    line = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) >= 8)
    counted = line.groupBy("line", "doc_id").agg(F.count("*").alias("n"))
    return counted.groupBy("line").agg(F.sum("n").alias("uses"), F.count("*").alias("files")).where("uses >= 5")


@spec("token_window_duplicates", """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS t FROM documents),
x AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 49, 0), 8)) AS s FROM w)
SELECT md5(array_to_string(t[s + 1:s + 50], ' ')) AS digest, count(*) AS windows, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_id FROM x GROUP BY 1 HAVING count(*) > 1""")
def token_window_duplicates(t):
    words = F.filter(F.split("text", "[ \t\n\r]+"), lambda x: x != "")
    wide = t.documents.select("doc_id", words.alias("t")).where(F.size("t") >= 50)
    # digests leave the row in which their words are; no window's text is shuffled
    digests = F.transform(F.sequence(F.lit(0), F.size("t") - 50, F.lit(8)), lambda s: F.md5(F.array_join(F.slice("t", s + 1, 50), " ").cast("binary")))
    each = wide.select("doc_id", F.explode(digests).alias("digest")).groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("digest").agg(F.sum("n").alias("windows"), F.count("*").alias("docs"), F.min("doc_id").alias("first_id")).where("windows > 1")


@spec("line_context", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, line, string_agg(line, ' / ') OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING) AS context FROM l)
SELECT doc_id, n::INTEGER AS line_no, md5(context) AS context FROM c WHERE regexp_matches(line, '[0-9]')""")
def line_context(t):
    each = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(-1, 3)
    made = each.withColumn("context", F.array_join(F.collect_list("line").over(w), " / "))
    return made.where(F.col("line").rlike("[0-9]")).select("doc_id", (F.col("n") + 1).alias("line_no"), F.md5(F.col("context").cast("binary")).alias("context"))


@spec("value_trace", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, line FROM l WHERE regexp_matches(line, '(^|[^0-9A-Za-z_.])(2\\.0|4\\.0)($|[^0-9A-Za-z_.]|\\.($|[^0-9]))'))
SELECT CASE WHEN line LIKE '#%' THEN 'comment' WHEN regexp_matches(line, '(?i)licen[cs]e') THEN 'license' ELSE 'text' END AS kind, count(*) AS sites, count(DISTINCT doc_id) AS files FROM h GROUP BY 1""")
def value_trace(t):
    line = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"(?<![\w.])(2\.0|4\.0)(?![\w]|\.\d)"))
    kind = F.when(F.col("line").startswith("#"), "comment").when(F.col("line").rlike("(?i)licen[cs]e"), "license").otherwise("text")
    return line.groupBy(kind.alias("kind")).agg(F.count("*").alias("sites"), F.countDistinct("doc_id").alias("files"))


@spec("benchmark_containment", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_containment(t):
    """Documents that hold an item's text, wherever it begins and ends.

    Each item is known by one run of ``GRAM`` bytes at a fixed place in it (its middle); a document's runs are hashed in the row and only
    those that an item has leave it.  Items shorter than that, of which there can be few different ones, are compared with every document.
    """
    return J.contained(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("item")))


@spec("dead_tokens", """WITH w AS (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) AS w FROM documents),
d AS (SELECT DISTINCT w FROM w WHERE lang = 'de'), u AS (SELECT DISTINCT w FROM w WHERE lang <> 'de') SELECT w AS word FROM d ANTI JOIN u USING (w)""")
def dead_tokens(t):
    w = t.documents.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), F.lit(1)))).alias("word"))
    return w.where("lang = 'de'").select("word").distinct().join(w.where("lang != 'de'").select("word").distinct(), "word", "left_anti")


@spec("symbol_callers", """WITH w AS (SELECT doc_id, lang, unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS w FROM documents),
s AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS w FROM part UNION SELECT unnest(['idiot', 'clown', 'trash']))
SELECT w AS symbol, count(*) FILTER (lang = 'en') AS inside, count(*) FILTER (lang <> 'en') AS outside FROM w JOIN s USING (w) WHERE length(w) > 2 GROUP BY w""")
def symbol_callers(t):
    w = t.documents.select("lang", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("symbol")).where(F.length("symbol") > 2)
    s = t.part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("symbol")).union(t.spark.createDataFrame([("idiot",), ("clown",), ("trash",)], "symbol string")).distinct()
    return w.join(s, "symbol").groupBy("symbol").agg(F.count_if(F.col("lang") == "en").alias("inside"), F.count_if(F.col("lang") != "en").alias("outside"))


@spec("html_blocks", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<script')) AS scripts, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def html_blocks(t):
    count = lambda tag: F.size(F.regexp_extract_all("html", F.lit(f"({tag})"), F.lit(1))).cast("long")
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), count("<script").alias("scripts"), count("<p>").alias("paragraphs"))


@spec("citations", """WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS cited FROM pages) SELECT cited, count(*) AS uses, count(DISTINCT page_id) AS pages FROM c
WHERE cited <> '' AND NOT regexp_matches(cited, '[ *?]|^[a-z]+://') GROUP BY cited""")
def citations(t):
    c = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("cited")).where((F.col("cited") != "") & ~F.col("cited").rlike("[ *?]|^[a-z]+://"))
    return c.groupBy("cited").agg(F.count("*").alias("uses"), F.countDistinct("page_id").alias("pages"))


URL_SQL = "u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


def url_paths(t):
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


@spec("unique_suffix_join", f"""WITH {URL_SQL}, p AS (SELECT DISTINCT path FROM u), q AS (SELECT DISTINCT regexp_replace(path, '^[^/]*/', '') AS raw FROM u),
s AS (SELECT path, array_to_string(string_split(path, '/')[i:], '/') AS suffix FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM p)),
o AS (SELECT suffix, min(path) AS path FROM s GROUP BY suffix HAVING count(*) = 1),
r AS (SELECT raw, i, array_to_string(string_split(raw, '/')[i:], '/') AS suffix FROM (SELECT raw, unnest(range(1, len(string_split(raw, '/')) + 1)) AS i FROM q))
SELECT q.raw AS raw_path, coalesce(e.path, b.path) AS matched FROM q LEFT JOIN p e ON e.path = q.raw LEFT JOIN (SELECT raw, min_by(path, i) AS path FROM r JOIN o USING (suffix) GROUP BY raw) b ON b.raw = q.raw""")
def unique_suffix_join(t):
    u = url_paths(t)
    return J.unique_suffix_join(u.select(F.regexp_replace("path", "^[^/]*/", "").alias("raw_path")).distinct(), u)


@spec("shortest_suffix_join", f"""WITH {URL_SQL}, p AS (SELECT DISTINCT path FROM u), q AS (SELECT DISTINCT regexp_replace(path, '^[^/]*/', '') AS cited FROM u)
SELECT cited, (SELECT path FROM p WHERE path = cited OR path LIKE '%/' || cited ORDER BY length(path), path LIMIT 1) AS matched FROM q""")
def shortest_suffix_join(t):
    u = url_paths(t)
    return J.shortest_suffix_join(u.select(F.regexp_replace("path", "^[^/]*/", "").alias("cited")).distinct(), u)


@spec("longest_prefix_assign", f"""WITH {URL_SQL}, h AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM u UNION SELECT DISTINCT split_part(path, '/', 1) || '/en' FROM u)
SELECT page_id, max_by(prefix, length(prefix)) AS module FROM u JOIN h ON path = prefix OR starts_with(path, prefix || '/') GROUP BY page_id""")
def longest_prefix_assign(t):
    u = url_paths(t)
    host = F.split_part("path", F.lit("/"), F.lit(1))
    prefixes = u.select(host.alias("prefix")).union(u.select(F.concat(host, F.lit("/en")))).distinct()
    return J.longest_prefix_join(u, prefixes).select("page_id", F.col("matched").alias("module"))
