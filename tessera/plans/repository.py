"""Queries over what paths, lines, requirements and messages of a repository say.

The tables hold no repository: parts, events and orders stand for its files, lines and messages, each with a text picked from a list by its number.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalogue import spec
from tessera.functions import paths as P
from tessera.functions import rubric as R
from tessera.functions import scoring as S
from tessera.functions import snippets as N
from tessera.functions import text as T


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(values: list, number):
    return F.get(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


def pick_sql(values: list, number: str) -> str:
    return "([" + ", ".join(quoted(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in values) + f"])[1 + ({number}) % {len(values)}]"


def any_sql(test: str, values: list[str]) -> str:
    return "(" + " OR ".join(test.format(quoted(v)) for v in values) + ")"


def in_sql(values: list[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


FOLDERS = ["src", "src/app", "tests", "pkg/__tests__", "docs", "db/migrations", ".github/workflows", "Examples", "api/schema", "lib/specs", "ci", "deploy"]
NAMES = [
    "main.py", "app.ts", "util.test.ts", "test_core.py", "conftest.py", "README", "README.md", "package.json", "Dockerfile", "Makefile", "schema.sql", "service.proto", "openapi.yaml", "notes.rst", "view.html", "bundle.min.js", "model_pb2.py", "deploy.yml", "query.graphql",
    "core.rs", "lib.go", "lib_test.go", "App.java", "style.scss", "data.xyz", "conf.ini", ".env", ".env.local", ".env.example", ".env.staging", "page.unknown", "codemap.html", "pr-12.html", "Jenkinsfile.groovy", "x.GENERATED.ts", "LICENSE", "tool.R", "a.b.CPP",
]
FILES_SQL = f"""f AS (SELECT p_partkey AS id, {pick_sql(FOLDERS, "p_partkey")} || '/' || {pick_sql(NAMES, f"p_partkey // {len(FOLDERS)}")} AS path, p_size AS loc FROM part),
n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1) AS ext FROM f)"""
TEST_SQL = any_sql("regexp_matches(lower(path), {})", P.TEST_PATHS)
LANGUAGE_SQL = "CASE lower(name) WHEN 'dockerfile' THEN 'Docker' WHEN 'makefile' THEN 'Make' ELSE CASE lower(ext) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " ELSE 'Other' END END"


def files(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), F.concat(pick(FOLDERS, k), F.lit("/"), pick(NAMES, F.floor(k / len(FOLDERS)))).alias("path"), F.col("p_size").alias("loc"))


@spec("language_by_name", f"WITH {FILES_SQL} SELECT id, path, {LANGUAGE_SQL} AS language FROM n")
def language_by_name(t):
    return files(t).select("id", "path", P.language(F.col("path")).alias("language"))


SOURCE_SQL = f"""NOT (list_has_any(string_split(lower(path), '/')[:-2], [{', '.join(map(quoted, P.DOC_FOLDERS))}]) OR lower(ext) IN {in_sql(P.NON_CODE)} OR (ext = '' AND split_part(lower(name), '.', 1) IN {in_sql(P.NON_CODE_NAMES)}) OR {any_sql('contains(lower(name), {})', P.GENERATED_MARKS)})"""


@spec("path_predicates", f"""WITH {FILES_SQL} SELECT id, {TEST_SQL} AS is_test, {SOURCE_SQL} AS is_source, regexp_matches(path, '{P.GENERATED_DOCUMENT}') AS is_generated,
name IN {in_sql(P.SECRET_NAMES)} OR (starts_with(name, '{P.SECRET_FAMILY}') AND name NOT IN {in_sql(P.SECRET_TEMPLATES)}) AS is_secret FROM n""")
def path_predicates(t):
    p = F.col("path")
    return files(t).select("id", P.is_test(p).alias("is_test"), P.is_source(p).alias("is_source"), P.is_generated_document(p).alias("is_generated"), P.is_secret_name(p).alias("is_secret"))


KIND_SQL = f"""CASE WHEN {TEST_SQL} THEN 'test' WHEN regexp_matches(lower(path), '{P.MIGRATION}') OR lower(ext) = '.sql' THEN 'schema/migration' WHEN lower(name) IN {in_sql(P.MANIFESTS)} THEN 'dependencies'
WHEN regexp_matches(lower(name), '{P.CONTRACT}') OR lower(ext) IN {in_sql(P.CONTRACT_SUFFIXES)} THEN 'api-contract' WHEN regexp_matches(lower(path), '{P.BUILD}') OR starts_with(lower(name), '.gitlab-ci') OR starts_with(lower(name), 'jenkinsfile') OR starts_with(lower(name), 'dockerfile') OR lower(name) = 'makefile' THEN 'build/ci'
WHEN lower(ext) IN {in_sql(P.DOC_SUFFIXES)} THEN 'docs' WHEN lower(ext) IN {in_sql(P.CONFIG_SUFFIXES)} THEN 'config' ELSE 'source' END"""


@spec("change_kinds", f"WITH {FILES_SQL} SELECT id, {KIND_SQL} AS kind FROM n")
def change_kinds(t):
    return files(t).select("id", P.change_kind(F.col("path")).alias("kind"))


@spec("inventory", f"""WITH {FILES_SQL}, g AS (SELECT {LANGUAGE_SQL} AS language, {TEST_SQL} AS is_test, split_part(path, '/', 1) AS folder, loc FROM n)
SELECT language, folder, count(*) AS files, sum(loc)::BIGINT AS loc, sum(CASE WHEN is_test THEN loc ELSE 0 END)::BIGINT AS test_loc, sum(CASE WHEN is_test THEN loc ELSE 0 END) / sum(loc) AS test_share FROM g GROUP BY language, folder""")
def inventory(t):
    """Files and lines by language and top folder, and how much of them is tests."""
    p = F.col("path")
    tested = F.sum(F.when(P.is_test(p), F.col("loc")).otherwise(0))
    by = files(t).groupBy(P.language(p).alias("language"), F.substring_index(p, "/", 1).alias("folder"))
    return by.agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), tested.alias("test_loc"), (tested / F.sum("loc")).alias("test_share"))


@spec("unrecognized_suffixes", f"WITH {FILES_SQL} SELECT CASE WHEN ext = '' THEN '(none)' ELSE lower(ext) END AS suffix, count(*) AS files FROM n WHERE {LANGUAGE_SQL} = 'Other' GROUP BY 1")
def unrecognized_suffixes(t):
    other = files(t).where(P.language(F.col("path")) == "Other")
    return other.groupBy(F.coalesce(F.nullif(F.lower(P.suffix(F.col("path"))), F.lit("")), F.lit("(none)")).alias("suffix")).agg(F.count("*").alias("files"))


TOP_SQL = f"""WITH {FILES_SQL}, d AS (SELECT 'folder' AS list, regexp_replace(path, '/[^/]*$', '') AS name, sum(loc)::BIGINT AS loc FROM f GROUP BY 2 ORDER BY loc DESC, name LIMIT 5),
l AS (SELECT 'file' AS list, path || '#' || id AS name, loc::BIGINT AS loc FROM f ORDER BY loc DESC, name LIMIT 20) SELECT * FROM d UNION ALL SELECT * FROM l"""


@spec("largest", TOP_SQL)
def largest(t):
    """The five largest folders and the twenty largest files: the feature is a top list."""
    f = files(t)
    d = f.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("name")).agg(F.sum("loc").alias("loc")).orderBy(F.desc("loc"), "name").limit(5)
    one = f.select(F.concat("path", F.lit("#"), F.col("id").cast("string")).alias("name"), F.col("loc").cast("long").alias("loc")).orderBy(F.desc("loc"), "name").limit(20)
    return d.select(F.lit("folder").alias("list"), "name", "loc").unionByName(one.select(F.lit("file").alias("list"), "name", "loc"))


ROOTS = ["src", "db/migrations", "api/"]


@spec("scope", f"WITH {FILES_SQL}, a AS (SELECT id, '/work/repo/' || path AS absolute, path FROM f) SELECT id, replace(replace(absolute, '/work/repo/', ''), '/work/repo', '.') AS relative, path = 'src' OR starts_with(path, 'src/') OR path = 'db/migrations' OR starts_with(path, 'db/migrations/') OR path = 'api/' OR starts_with(path, 'api/') AS inside FROM a")
def scope(t):
    made = files(t).withColumn("relative", P.relative(F.concat(F.lit("/work/repo/"), F.col("path")), "/work/repo"))
    return made.select("id", "relative", P.within(F.col("relative"), F.array(*map(F.lit, ROOTS))).alias("inside"))


EVIDENCE = ["src/a.py:12", "src/app/b.py", "docs/x.md:3", "", None, "srcs/c.py:9"]


@spec("scope_by_evidence", f"""WITH e AS (SELECT p_partkey AS id, regexp_replace({pick_sql(EVIDENCE, "p_partkey")}, ':[0-9]+$', '') AS first FROM part) SELECT id, coalesce(first = 'src' OR starts_with(first, 'src/'), false) AS inside FROM e""")
def scope_by_evidence(t):
    """Inventory rows whose first evidence lies in the scope; a row without evidence is in none."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.array(pick(EVIDENCE, F.col("p_partkey")), F.lit("src/other.py")).alias("evidence"))
    return rows.select("id", P.within(F.regexp_replace(F.get("evidence", F.lit(0)), r":\d+$", ""), F.array(F.lit("src"))).alias("inside"))


HREFS = [("docs/a/index.html", "docs/b/page one.html"), ("index.html", "x/y.html"), ("a/b/c.html", "a/b/d.html"), ("a/b/c.html", "a/e.html"), ("a/b.html", "b.html"), ("a/a/x.html", "a/b/a/x#1.html")]
HREF_WANT = ["../b/page%20one.html", "x/y.html", "d.html", "../e.html", "../b.html", "../b/a/x%231.html"]


@spec("relative_hrefs", f"SELECT p_partkey AS id, {pick_sql(HREF_WANT, 'p_partkey')} AS href FROM part")
def relative_hrefs(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), P.href(pick([a for a, _ in HREFS], k), pick([b for _, b in HREFS], k)).alias("href"))


# -- findings --------------------------------------------------------------------------------------------------------------------------

SEVERITY_SQL = """SELECT p_partkey AS id, CASE WHEN p_size / 20.0 >= 2 THEN 'high' WHEN p_size / 20.0 >= 1.5 THEN 'medium' ELSE 'low' END AS by_ratio, CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 25 THEN 'medium' END AS by_metric,
CASE WHEN p_size % 5 = 0 THEN 'low' WHEN p_size % 7 = 0 THEN 'medium' WHEN p_size * 2 >= 90 THEN 'high' WHEN p_size * 2 >= 70 THEN 'medium' ELSE 'low' END AS by_confidence, CASE WHEN p_size >= 40 THEN 'M' ELSE 'S' END AS effort FROM part"""


@spec("graded_severities", SEVERITY_SQL)
def graded_severities(t):
    size = F.col("p_size")
    given = F.when(size % 5 == 0, "low")
    confidence = F.when(size % 7 != 0, size * 2)
    metric = R.metric_grade(size, F.lit(25), F.lit(40))
    return t.part.select(F.col("p_partkey").alias("id"), R.ratio_severity(size, F.lit(20)).alias("by_ratio"), metric.alias("by_metric"), R.confidence_severity(given, confidence).alias("by_confidence"), R.effort(metric).alias("effort"))


KINDS = ["n_plus_one_query", "merge_conflict_marker", "latest_dependency", "missing_test", "greatest_hits", "Unused_import", "auth_bypass", "odd", "too_many_args", "god_module", "", None, "long_method", "deprecated_call", "hotspot", "contest"]
SOURCES = ["security", "hygiene", "made_up", None, "", "dead_stuff", "coverage", "my_secrets", "protests"]


def lookup_sql(table: dict[str, str], value: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def keyword_sql(value: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({value}), '(^|[^\\p{{L}}\\p{{N}}]){needle}') THEN '{c}'" for needle, c in R.KEYWORDS) + " END"


TYPED_SQL = f"""t AS (SELECT p_partkey AS id, {pick_sql(SOURCES, 'p_partkey // 16')} AS detector, {pick_sql(KINDS, 'p_partkey')} AS smell, CASE WHEN p_partkey % 3 = 0 THEN 'typed_' || p_size END AS named FROM part),
c AS (SELECT id, detector, coalesce(nullif(smell, ''), nullif(named, ''), 'issue') AS type FROM t),
g AS (SELECT id, type, coalesce({lookup_sql(R.by_name(R.DETECTORS), 'detector')}, {lookup_sql(R.by_name(R.TYPES), 'type')}, {keyword_sql('type')}, {keyword_sql("nullif(detector, '')")}) AS found FROM c)"""


def typed(t):
    k = F.col("p_partkey")
    rows = t.part.select(k.alias("id"), pick(SOURCES, F.floor(k / 16)).alias("detector"), pick(KINDS, k).alias("smell"), F.when(k % 3 == 0, F.concat(F.lit("typed_"), F.col("p_size").cast("string"))).alias("named"))
    rows = rows.withColumn("type", S.finding_type(F.col("smell"), F.col("named")))
    category, matched = R.categorize(F.col("detector"), F.col("type"))
    return rows.select("id", "type", category.alias("category"), matched.alias("matched"))


@spec("finding_categories", f"WITH {TYPED_SQL} SELECT id, type, coalesce(found, 'hygiene') AS category, found IS NOT NULL AS matched FROM g")
def finding_categories(t):
    return typed(t)


@spec("counts_by_type", f"WITH {TYPED_SQL} SELECT type, coalesce(found, 'hygiene') AS category, count(*) AS n FROM g GROUP BY ALL")
def counts_by_type(t):
    return typed(t).groupBy("type", "category").agg(F.count("*").alias("n"))


@spec("unmapped_finding_types", f"WITH {TYPED_SQL} SELECT DISTINCT type FROM g WHERE found IS NULL")
def unmapped_finding_types(t):
    return typed(t).where("not matched").select("type").distinct()


FOUND_SQL = f"""s AS (SELECT id, type, {pick_sql(['high', 'medium', 'low', 'odd'], 'id')} AS severity, {pick_sql(['finding', 'candidate', 'finding'], 'id')} AS kind, 'f' || id % 50 AS file, {pick_sql(['12', ' 7 ', 'x', None, '3.5', ''], 'id')} AS raw FROM c),
o AS (SELECT *, CASE severity WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END AS rank, coalesce(CASE WHEN regexp_matches(trim(raw), '^[0-9]+$') THEN trim(raw)::INTEGER END, 0) AS line FROM s)"""


def found(t):
    k = F.col("id")
    rows = typed(t).select("id", "type", pick(["high", "medium", "low", "odd"], k).alias("severity"), pick(["finding", "candidate", "finding"], k).alias("kind"), F.concat(F.lit("f"), (k % 50).cast("string")).alias("file"), pick(["12", " 7 ", "x", None, "3.5", ""], k).alias("raw"))
    return rows.withColumn("rank", S.severity_rank(F.col("severity"))).withColumn("line", R.line_number(F.col("raw")))


@spec("findings_in_order", f"WITH {TYPED_SQL}, {FOUND_SQL}, a AS (SELECT id, kind, line, row_number() OVER (ORDER BY kind <> 'finding', rank, file, line, id) AS place FROM o) SELECT * FROM a WHERE place <= 300")
def findings_in_order(t):
    """Kind, severity, file, line: the first 300 rows of the report and their places (the feature is a page of it)."""
    top = found(t).withColumn("later", F.col("kind") != "finding").orderBy("later", "rank", "file", "line", "id").limit(300)
    return top.withColumn("place", F.row_number().over(Window.orderBy("later", "rank", "file", "line", "id"))).select("id", "kind", "line", "place")


@spec("findings_and_candidates", f"WITH {TYPED_SQL}, {FOUND_SQL} SELECT kind, severity, count(*) AS n, count(DISTINCT file) AS files FROM o WHERE type NOT IN ('odd', 'contest') GROUP BY kind, severity")
def findings_and_candidates(t):
    """Rules that the caller ignores are left out; candidates are counted apart from findings."""
    return found(t).where(~F.col("type").isin("odd", "contest")).groupBy("kind", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@spec("distinct_findings", f"WITH {TYPED_SQL}, {FOUND_SQL} SELECT file, line, type, severity, min(id) AS first FROM o GROUP BY ALL")
def distinct_findings(t):
    return found(t).groupBy("file", "line", "type", "severity").agg(F.min("id").alias("first"))


REPORTS_SQL = """r AS (SELECT o_orderkey AS report, list_transform([0, 1, 2], lambda i: 'c' || ((o_orderkey + i * 3) % 11)) AS ran, list_transform([1, 2], lambda i: 'c' || ((o_orderkey * i) % 13)) AS skipped, ['c' || (o_custkey % 11)] AS errored FROM orders WHERE o_orderkey % 1000 < 5)"""


def reports(t):
    k = F.col("o_orderkey")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    rows = t.orders.where(k % 1000 < 5)
    return rows.select(k.alias("report"), F.array(*(name((k + i * 3) % 11) for i in range(3))).alias("ran"), F.array(name(k % 13), name(k * 2 % 13)).alias("skipped"), F.array(name(F.col("o_custkey") % 11)).alias("errored"), F.array(*(F.lit(f"c{i}") for i in range(9))).alias("profile"))


@spec("coverage_of_reports", f"""WITH {REPORTS_SQL}, e AS (SELECT unnest(list_filter(ran, lambda x: NOT list_contains(skipped, x) AND NOT list_contains(errored, x) AND x NOT IN ('c9', 'c10'))) AS category FROM r), n AS (SELECT unnest(ran) AS category FROM r UNION SELECT unnest(skipped) FROM r)
SELECT category, category IN (SELECT category FROM e) AS graded FROM n""")
def coverage_of_reports(t):
    return R.covered(reports(t))


@spec("skipped_everywhere", f"WITH {REPORTS_SQL} SELECT DISTINCT unnest(skipped) AS category FROM r EXCEPT SELECT unnest(ran) FROM r")
def skipped_everywhere(t):
    return R.skipped_everywhere(reports(t))


@spec("grades_without_incomplete", f"""WITH s(category, score) AS (VALUES {', '.join(f"('{c}', {90 - i})" for i, c in enumerate(S.CATEGORIES))}), b AS (SELECT {pick_sql([*R.GATES, 'other'], 'n_nationkey')} AS block, n_nationkey % 4 <> 1 AS adequate FROM nation),
d AS (SELECT {lookup_sql(R.GATES, 'block')} AS category FROM b WHERE NOT adequate) SELECT category, score FROM s WHERE category NOT IN (SELECT category FROM d WHERE category IS NOT NULL)""")
def grades_without_incomplete(t):
    scores = t.spark.createDataFrame([(c, 90 - i) for i, c in enumerate(S.CATEGORIES)], "category string, score int")
    k = F.col("n_nationkey")
    return R.without_incomplete(scores, t.nation.select(pick([*R.GATES, "other"], k).alias("block"), (k % 4 != 1).alias("adequate")))


# -- lines -----------------------------------------------------------------------------------------------------------------------------

LINES = [
    "total = 1  # TODO: later", 'url = "https://x.y"; work()', "s = 'it' // FIXME now", "x -- HACK y", "plain text", 'a = "b # TODO"', "; XXX asm", "TODO without", "`tick // TODO` # none", "<<<<<<< HEAD", "=======", ">>>>>>> branch", "'open // TODO", '"a\\"b # c" // d',
    "if score >= 0.75 and accuracy(rows) < .9f:", "while 0.05 > pvalue:", "max_retries > 3", "QUALITY_THRESHOLD = 0.8", "if self.win_rate == 0.5:", "x >= 1e-3", "learningRate < 0.1", "if 0.7 <= judge.score:", "minGate != 2",
]
LINE_SQL = f"l AS (SELECT event_id AS id, 'f' || user_id % 40 AS file, {pick_sql(LINES, 'event_id')} AS line FROM events)"
PIECES_SQL = """list_transform(regexp_extract_all(line, '"(?:\\\\.|[^"])*"|''(?:\\\\.|[^''])*''|`(?:\\\\.|[^`])*`|[^"''`]+|["''`]'), lambda x: CASE WHEN length(x) > 1 AND x[1] IN ('"', '''', '`') THEN x[1] || repeat(' ', length(x) - 2) || x[-1] ELSE x END)"""


def source_lines(t):
    k = F.col("event_id")
    return t.events.select(k.alias("id"), F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("file"), pick(LINES, k).alias("line"))


BODY_SQL = "CASE " + " ".join(f"WHEN strpos(blank, '{p}') > 0 THEN trim(substr(line, strpos(blank, '{p}') + {len(p)}))" for p in N.PREFIXES) + " END"


@spec("hygiene_lines", f"""WITH {LINE_SQL}, b AS (SELECT *, array_to_string({PIECES_SQL}, '') AS blank FROM l), c AS (SELECT *, {BODY_SQL} AS body FROM b)
SELECT id, 'todo_inventory' AS type, regexp_extract(body, '{N.DEBT}', 1) || ': ' || left(body, 80) AS detail FROM c WHERE regexp_matches(body, '{N.DEBT}')
UNION ALL SELECT id, 'merge_conflict_marker', left(line, 120) FROM c WHERE {any_sql('starts_with(line, {})', N.MERGE_MARKS)}""")
def hygiene_lines(t):
    """Debt in comments and merge markers: each rule adds rows of one shape."""
    body = source_lines(t).select("id", "line", N.comment_body(F.col("line")).alias("body"))
    debt = F.when(F.col("body").rlike(N.DEBT), F.struct(F.lit("todo_inventory").alias("type"), F.concat(F.regexp_extract("body", N.DEBT, 1), F.lit(": "), F.left("body", F.lit(80))).alias("detail")))
    mark = F.when(P._any(F.col("line"), N.MERGE_MARKS, lambda c, m: c.startswith(m)), F.struct(F.lit("merge_conflict_marker").alias("type"), F.left("line", F.lit(120)).alias("detail")))
    return body.select("id", F.explode(F.filter(F.array(debt, mark), lambda x: x.isNotNull())).alias("x")).select("id", "x.type", "x.detail")


# RE2 has no look-ahead: a blank goes before the last capital of a run that goes on in lower case
TOKENS_SQL = "list_transform(regexp_extract_all(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+'), lambda x: lower(x))"
IDENTIFIERS = ["HTTPServerError", "win_rate", "learningRate", "qualityScore2", "NDCG_AT_10", "x", "maxScore", "MIN_GATE", "max_retries", "passRate", "ABc", "bleu4", "__init__", "Threshold"]


def words_sql(words: list[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


METRIC_SQL = f"(list_has_any(k, {words_sql(N.MEASURES)}) OR (list_contains(k, 'rate') AND list_has_any(k, {words_sql(N.RATE_PARTNERS)})))"
THRESHOLD_SQL = f"(list_has_any(k, {words_sql(N.THRESHOLDS)}) AND (list_has_any(k, {words_sql(N.MEASURES)}) OR list_has_any(k, {words_sql(N.BARE_THRESHOLDS)})))"


@spec("measure_names", f"WITH i AS (SELECT p_partkey AS id, {pick_sql(IDENTIFIERS, 'p_partkey')} AS name FROM part), j AS (SELECT *, {TOKENS_SQL.format('name')} AS k FROM i) SELECT id, array_to_string(k, ' ') AS tokens, {METRIC_SQL} AS is_metric, {THRESHOLD_SQL} AS is_threshold FROM j")
def measure_names(t):
    k = T.tokens(pick(IDENTIFIERS, F.col("p_partkey")))
    return t.part.select(F.col("p_partkey").alias("id"), k.alias("k")).select("id", F.array_join("k", " ").alias("tokens"), N.is_metric(F.col("k")).alias("is_metric"), N.is_threshold(F.col("k")).alias("is_threshold"))


#: What the lines with comparisons say; DuckDB's patterns can't look around, so its side has them written out.
COMPARED = {14: [("score", ">=", "0.75"), ("rows", "<", ".9")], 15: [("pvalue", "<", "0.05")], 18: [("win_rate", "==", "0.5")], 21: [("score", ">=", "0.7")], 22: [("minGate", "!=", "2")]}
THRESHOLDS_SQL = "v(k, name, operator, number) AS (VALUES " + ", ".join(f"({k}, '{n}', '{o}', '{x}')" for k, rows in COMPARED.items() for n, o, x in rows if n != "rows") + ", (14, 'accuracy', '<', '.9'))"


@spec("measure_thresholds", f"WITH {THRESHOLDS_SQL} SELECT event_id AS id, name, operator, number FROM events JOIN v ON event_id % {len(LINES)} = k")
def measure_thresholds(t):
    """Comparisons that gate on a measure, the number's side made the same."""
    each = source_lines(t).select("id", F.explode(N.comparisons(F.col("line"))).alias("x")).select("id", "x.*").withColumn("k", T.tokens(F.col("name")))
    return each.where(N.is_metric(F.col("k")) | N.is_threshold(F.col("k"))).drop("k")


CANDIDATE_KINDS = ["no_consumer", "renormalized_composite", "zero_default", "composite_weight", "threshold", "metric_definition"]
CANDIDATES_SQL = f"""c AS (SELECT l_partkey % 100 AS file, l_linenumber AS line, {pick_sql([*CANDIDATE_KINDS, 'other'], 'l_orderkey + l_partkey')} AS kind, l_returnflag AS detail, l_suppkey % 9 = 0 AS names_measure FROM lineitem WHERE l_quantity > 30),
m AS (SELECT DISTINCT file FROM c WHERE kind IN ('threshold', 'metric_definition') AND line < 3), z AS (SELECT * FROM c WHERE kind NOT IN ('zero_default') OR names_measure OR file IN (SELECT file FROM m))"""


@spec("measure_candidates", f"""WITH {CANDIDATES_SQL}, d AS (SELECT DISTINCT kind, file, line, detail FROM z)
SELECT * FROM d ORDER BY coalesce(list_position({words_sql(CANDIDATE_KINDS)}, kind), 99), file, line, detail LIMIT 60""")
def measure_candidates(t):
    """Zero defaults only where a file measures or the line names a measure; one row of each; in the kinds' fixed order, a page of 60 (the feature)."""
    k = F.col("l_orderkey") + F.col("l_partkey")
    c = t.lineitem.where("l_quantity > 30").select((F.col("l_partkey") % 100).alias("file"), F.col("l_linenumber").alias("line"), pick([*CANDIDATE_KINDS, "other"], k).alias("kind"), F.col("l_returnflag").alias("detail"), (F.col("l_suppkey") % 9 == 0).alias("names"))
    measured = c.where("kind in ('threshold', 'metric_definition') and line < 3").select(F.col("file").alias("m")).distinct()
    kept = c.join(measured, F.col("file") == F.col("m"), "left").where("kind != 'zero_default' or names or m is not null")
    place = F.nullif(F.array_position(F.array(*map(F.lit, CANDIDATE_KINDS)), F.col("kind")), F.lit(0))
    return kept.select("kind", "file", "line", "detail").distinct().orderBy(F.coalesce(place, F.lit(99)), "file", "line", "detail").limit(60)


# -- requirements and versions ---------------------------------------------------------------------------------------------------------

SPECS = [" Django>=4.2,<5.0", "django~=6.1.0", "-r base.txt", "", "requests[socks] >= 2", "my.pkg-name==1.0 ; x", "Flask", "numpy !=1.2", "celery@git", "pkg 1999 5.1", "a==2026", "b >=21,<6.0.1", None]
HEADS = ["django", "django", "", "", "requests", "my.pkg-name", "flask", "numpy", "celery@git", "pkg", "a", "b", None]
DISTRIBUTIONS = ["django", "django", "_r", "", "requests", "my_pkg_name", "flask", "numpy", "celery", "pkg", "a", "b", None]
MAJORS, MINORS, ENDED = [4, 6, None, None, 2, 1, None, 1, None, 5, None, 6, None], [2, 1, None, None, 0, 0, None, 2, None, 1, None, 0, None], [True, False, False, False, True, True, False, True, False, True, False, False, False]


@spec("requirements", f"SELECT p_partkey AS id, {pick_sql(HEADS, 'p_partkey')} AS head, {pick_sql(DISTRIBUTIONS, 'p_partkey')} AS distribution, {pick_sql(MAJORS, 'p_partkey')}::INTEGER AS major, {pick_sql(MINORS, 'p_partkey')}::INTEGER AS minor, {pick_sql(ENDED, 'p_partkey')} AS ended FROM part")
def requirements(t):
    """The expected values are worked by hand, one for each text."""
    s = t.part.select(F.col("p_partkey").alias("id"), pick(SPECS, F.col("p_partkey")).alias("spec")).withColumn("v", N.version(F.col("spec")))
    return s.select("id", N.requirement_head(F.col("spec")).alias("head"), N.distribution(F.col("spec")).alias("distribution"), F.col("v.major").alias("major"), F.col("v.minor").alias("minor"), N.is_ended(F.col("v")).alias("ended"))


RANGES = [("^1.2.3", "1.9.0", True), ("^1.2.3", "2.0.0", False), ("^0.2.3", "0.3.0", False), ("^0.2", "0.2.9", True), ("~1.2", "1.2.9", True), ("~1.2.0", "1.3.0", False), ("1.x", "1.7.3", True), ("1.2.x", "1.3.0", False), ("1.2.3", "1.2.3", True), ("1.2.3", "1.2.4", False), ("*", "9.9.9", True), (">=2", "1.0.0", True), ("", "1.0.0", True), ("latest", "1.0.0", True), ("1.2.3", "", True), ("1.2.3", "beta", True), (None, "1.0.0", True), ("1.2.3", None, True), ("2", "2.5.1", True)]


@spec("semver_ranges", f"SELECT p_partkey AS id, {pick_sql([x for _, _, x in RANGES], 'p_partkey')} AS satisfied FROM part")
def semver_ranges(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), N.satisfies(pick([a for a, _, _ in RANGES], k), pick([b for _, b, _ in RANGES], k)).alias("satisfied"))


@spec("version_changes", """WITH v AS (SELECT p_partkey AS id, 1 + p_size % 6 AS major, p_partkey % 4 AS minor FROM part), c(change, dmajor, dminor, rmajor, rminor) AS (VALUES ('a', 2, 1, 3, 0), ('b', 4, 0, 5, 1), ('c', 5, 2, 6, 0))
SELECT id, change, CASE WHEN (rmajor, rminor) <= (major, minor) THEN 'high' WHEN (dmajor, dminor) <= (major, minor) THEN 'medium' WHEN (rmajor, rminor) <= (major + 1, 0) THEN 'low' END AS severity FROM v, c""")
def version_changes(t):
    """A fixed rule table beside every project's version; versions compare as structs."""
    pair = lambda a, b: F.struct(a.cast("int").alias("major"), b.cast("int").alias("minor"))
    v = t.part.select(F.col("p_partkey").alias("id"), pair(1 + F.col("p_size") % 6, F.col("p_partkey") % 4).alias("v"))
    rules = [("a", 2, 1, 3, 0), ("b", 4, 0, 5, 1), ("c", 5, 2, 6, 0)]
    each = v.withColumn("r", F.explode(F.array(*(F.struct(F.lit(n).alias("change"), pair(F.lit(a), F.lit(b)).alias("d"), pair(F.lit(c), F.lit(d)).alias("x")) for n, a, b, c, d in rules))))
    return each.select("id", "r.change", N.version_severity(F.col("v"), F.col("r.d"), F.col("r.x"), pair(F.col("v.major") + 1, F.lit(0))).alias("severity"))


# -- messages --------------------------------------------------------------------------------------------------------------------------

CHECKS = [("COMPLETED", "SUCCESS"), ("COMPLETED", "FAILURE"), ("IN_PROGRESS", ""), ("", "PENDING"), ("COMPLETED", "timed_out"), ("QUEUED", None), ("", "SUCCESS"), ("COMPLETED", "NEUTRAL"), ("", "ERROR"), (None, None)]
CHECK_SQL = f"""SELECT {pick_sql([a for a, _ in CHECKS], 'event_id')} AS status, {pick_sql([b for _, b in CHECKS], 'event_id')} AS conclusion, user_id AS pr FROM events"""


@spec("check_rollup", f"""WITH c AS ({CHECK_SQL}), u AS (SELECT pr, upper(coalesce(conclusion, '')) AS c, upper(coalesce(status, '')) AS s FROM c),
k AS (SELECT pr, CASE WHEN s <> '' AND s <> 'COMPLETED' AND c = '' THEN 'pending' WHEN c IN ('FAILURE', 'TIMED_OUT', 'CANCELLED', 'ACTION_REQUIRED', 'ERROR') THEN 'failing' WHEN c IN ('PENDING', 'EXPECTED', 'QUEUED', 'IN_PROGRESS') THEN 'pending' ELSE 'passing' END AS state FROM u)
SELECT pr, count(*) FILTER (state = 'failing') AS failing, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'passing') AS passing FROM k GROUP BY pr""")
def check_rollup(t):
    from tessera.functions.reviews import check_state

    k = F.col("event_id")
    state = check_state(pick([a for a, _ in CHECKS], k), pick([b for _, b in CHECKS], k))
    return t.events.groupBy(F.col("user_id").alias("pr")).agg(*(F.count_if(state == x).alias(x) for x in ("failing", "pending", "passing")))


THREADS_SQL = """t AS (SELECT conv_id, turn, conv_id % 3 = 0 AS resolved, conv_id % 4 = 0 AS outdated, 'p' || conv_id % 7 AS path, CASE WHEN conv_id % 5 <> 0 THEN turn END AS line, conv_id % 11 AS original, role, text FROM conversations),
n AS (SELECT conv_id, any_value(resolved) AS resolved, any_value(outdated) AS outdated, any_value(path) AS path, coalesce(nullif(max(line), 0), any_value(original)) AS line, array_to_string(list_sort(list_distinct(list(role))), ',') AS participants, count(*) AS comments FROM t GROUP BY conv_id)"""


@spec("review_threads", f"WITH {THREADS_SQL} SELECT *, row_number() OVER (PARTITION BY path ORDER BY resolved, outdated, coalesce(line, 0), conv_id) AS place FROM n")
def review_threads(t):
    """Threads with their participants and places: open and current ones first, then outdated, then resolved."""
    c = F.col("conv_id")
    by = t.conversations.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("participants"), F.count("*").alias("comments"), F.max(F.when(c % 5 != 0, F.col("turn"))).alias("line"))
    rows = by.select("conv_id", (c % 3 == 0).alias("resolved"), (c % 4 == 0).alias("outdated"), F.concat(F.lit("p"), (c % 7).cast("string")).alias("path"), F.coalesce(F.nullif("line", F.lit(0)), c % 11).alias("line"), "participants", "comments")
    order = Window.partitionBy("path").orderBy("resolved", "outdated", F.coalesce("line", F.lit(0)), "conv_id")
    return rows.withColumn("place", F.row_number().over(order))


@spec("related_items", """WITH r AS (SELECT o_custkey AS issue, CASE WHEN o_orderkey % 2 = 0 THEN 'PullRequest' ELSE 'Issue' END AS kind, o_orderkey % 20 AS number, o_orderpriority = '1-URGENT' AS closes, o_orderkey AS ordinal FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY issue, kind, number ORDER BY ordinal) AS n FROM r WHERE number > 0) SELECT issue, kind, number, closes, row_number() OVER (PARTITION BY issue ORDER BY NOT closes, kind <> 'PullRequest', number) AS place FROM f WHERE n = 1""")
def related_items(t):
    """The first mention of each item; those that close the issue first, then pull requests."""
    from tessera.operators.dedupe import first_wins

    k = F.col("o_orderkey")
    r = t.orders.select(F.col("o_custkey").alias("issue"), F.when(k % 2 == 0, "PullRequest").otherwise("Issue").alias("kind"), (k % 20).alias("number"), (F.col("o_orderpriority") == "1-URGENT").alias("closes"), k.alias("ordinal")).where("number > 0")
    order = Window.partitionBy("issue").orderBy(~F.col("closes"), F.col("kind") != "PullRequest", "number")
    return first_wins(r, ["issue", "kind", "number"], "ordinal").withColumn("place", F.row_number().over(order)).select("issue", "kind", "number", "closes", "place")


MESSAGES = ["see ```python\nTraceback (most recent call last):\n x\n``` in src/a/b.py ok", "```suggestion\nx = 1\n``` and ```suggestion\ny\n```", "look at lib/x.md and a/b/c.ts:12, not http://h/z.go", "none", None, "```\npanic: x\n``` ./d/e.rs", "(pkg/m.yaml)"]
LEADS = [("1", "1", "src/a/b.py", ""), ("2", "0", "", "x = 1\n|y\n"), ("0", "0", "a/b/c.ts", ""), ("0", "0", "", ""), ("0", "0", "", ""), ("1", "1", "./d/e.rs", ""), ("0", "0", "pkg/m.yaml", "")]


@spec("reproduction_leads", f"SELECT event_id AS id, {pick_sql([a for a, *_ in LEADS], 'event_id')}::INTEGER AS blocks, {pick_sql([b for _, b, *_ in LEADS], 'event_id')}::INTEGER AS traces, {pick_sql([c for _, _, c, _ in LEADS], 'event_id')} AS paths, {pick_sql([d for *_, d in LEADS], 'event_id')} AS suggestions FROM events")
def reproduction_leads(t):
    """Blocks, traces, paths and suggestions of messages; the expected values are worked by hand."""
    from tessera.functions import reviews as V

    m = t.events.select(F.col("event_id").alias("id"), F.coalesce(pick(MESSAGES, F.col("event_id")), F.lit("")).alias("text"))
    text = F.col("text")
    return m.select("id", F.size(V.blocks(text)).alias("blocks"), F.size(F.filter(V.blocks(text), V.is_trace)).alias("traces"), F.array_join(V.mentioned(text), ",").alias("paths"), F.array_join(V.suggestions(text), "|").alias("suggestions"))


PAGES = ["`src/api/client.py:88` and [x](docs/y.md)", "[u](https://h/x) `git commit -m x` lib/z.go:9", "`~/x/y` `/etc/hosts` `a/<b>` `-f/x`", "`./tools/run.sh` then pkg/a/b.ts.", "plain", "[m](mailto:a@b/c) [n](#frag) `x/y z`", "`a/b.py:3-9`"]
CITED_WANT = ["src/api/client.py:88|docs/y.md", "lib/z.go", "", "tools/run.sh|pkg/a/b.ts", "", "", "a/b.py:3"]


@spec("markdown_citations", f"SELECT p_partkey AS id, {pick_sql(CITED_WANT, 'p_partkey')} AS cited FROM part")
def markdown_citations(t):
    each = F.transform(N.citations(pick(PAGES, F.col("p_partkey"))), lambda x: F.concat(x["path"], F.when(x["line"].isNotNull(), F.concat(F.lit(":"), x["line"].cast("string"))).otherwise("")))
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(each, "|").alias("cited"))


VALUES = ["1,5-9", " 9–3 x 4", "", "7", "a-b,12-12", None]
RANGES_WANT, NORMAL, NORMAL_WANT = ["1-1 5-9", "3-9 4-4", "", "7-7", "12-12", None], ["./a/./b", "a/../b/c", "/x//y/", "..\\z", "a\\b", "."], ["a/b", "b/c", "x/y", "../z", "a/b", ""]
GLOBS, GLOBS_WANT = ["p/{name}.txt", "a/b.txt", "x/%s/%(k)s", "q/**/r?", "${d}/f"], ["p/*.txt", None, "x/*/*", "q/*/r?", "*/f"]
SECRETS, SECRETS_WANT = ["your-api-key", "sk_live_1", "<YOUR KEY>", "see example.com", "Lorem Ipsum dolor", "insert_token_here", "change_me", "real"], [True, False, True, True, True, True, True, False]
MODELS, MODELS_WANT = ["m = 'gpt-4o' + \"claude\"", "'mistral-7b' 'gpt'", "none", '"o3-mini"'], ["gpt-4o", "mistral-7b", "", "o3-mini"]


@spec("small_texts", f"""SELECT p_partkey AS id, {pick_sql(RANGES_WANT, 'p_partkey')} AS ranges, {pick_sql(NORMAL_WANT, 'p_partkey')} AS normal, {pick_sql(GLOBS_WANT, 'p_partkey')} AS glob, {pick_sql(SECRETS_WANT, 'p_partkey')} AS placeholder, {pick_sql(MODELS_WANT, 'p_partkey')} AS models,
'&lt;b a=&quot;' || p_size || '&quot;&gt;&amp;&#x27;' AS escaped, '{{"x":"<\\/script>"}}' AS json, left(CASE WHEN p_size % 6 > 3 THEN 'a' || chr(10) || 'b' || chr(10) || '...' WHEN p_size % 6 >= 3 THEN 'a' || chr(10) || 'b' ELSE ['', 'a', 'a'][1 + p_size % 6] END, 100) AS preview FROM part""")
def small_texts(t):
    """Line ranges, normal paths, patterns, placeholders, model names, escapes and previews; worked by hand, one value for each text."""
    k, size = F.col("p_partkey"), F.col("p_size")
    spans = F.array_join(F.transform(N.line_ranges(pick(VALUES, k)), lambda x: F.concat(x["low"].cast("string"), F.lit("-"), x["high"].cast("string"))), " ")
    lines = F.slice(F.array(*map(F.lit, ["  a ", "", " b", "c", "d"])), F.lit(1), size % 6)
    return t.part.select(
        k.alias("id"), spans.alias("ranges"), N.repository_path(pick(NORMAL, k)).alias("normal"), N.as_glob(pick(GLOBS, k)).alias("glob"), N.is_placeholder(pick(SECRETS, k)).alias("placeholder"), F.array_join(N.models(pick(MODELS, k)), ",").alias("models"),
        N.escaped(F.concat(F.lit('<b a="'), size.cast("string"), F.lit("\">&'"))).alias("escaped"), N.in_script(F.lit('{"x":"</script>"}')).alias("json"), N.preview(lines).alias("preview"),
    )
