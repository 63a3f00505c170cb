"""URL filters: rules on hosts and paths, carried along redirects and canonical links.

Two pages are aliases when a chain of redirect or canonical-link edges joins their addresses (host and path).  An address with a rule of
its own follows it: an explicit allow holds even where an alias is blocked.  An address without one is blocked when any address of its
component is explicitly blocked, and is allowed otherwise.

Only DataFrame functions; the aliases come from ``graph.components``.

Limits: of a page's canonical links and refresh tags the first of each counts; a target counts if it is absolute or begins with ``/`` or
``//``.  Targets relative to the page's folder make no alias; pass them as ``edges``.

Edge cases: a null url, or one with no ``://``, has an empty host and path, fits no rule and has no aliases (allow).  A null page id is
kept.  Repeated rows are judged alike.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle
from tessera.llm.graph import components

#: (host, path, verdict); fixed by the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rules are compiled into the plan; longer lists belong in a table that is joined by host suffix.
MAX_RULES = 1000
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, found).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(host: Column, path: Column, rules=None) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null where none does."""
    rules = RULES if rules is None else rules
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled into a plan")
    best = None
    for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        made = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, made) if best is None else best.when(fits, made)
    return best if best is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def alias_edges(pages: DataFrame) -> DataFrame:
    """``edges(a, b)`` between addresses, from ``<link rel=canonical>`` and ``<meta http-equiv=refresh>``; distinct."""
    html, url = F.col("html"), F.col("url")
    tag = F.explode(F.array(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1), F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1)))
    scheme = F.substring_index(url, "://", 1)
    full = F.when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to"))).when(F.col("to").startswith("/"), F.concat(scheme, F.lit("://"), host_of(url), F.col("to"))).otherwise(F.col("to"))
    marked = F.lower(html).rlike(r"""rel\s*=\s*["']?canonical|http-equiv\s*=\s*["']?refresh""")
    return (
        pages.where(marked & (F.instr(url, "://") > 0)).select("url", tag.alias("to")).where("to != ''").select("url", full.alias("to")).where(F.instr("to", "://") > 0)
        .select(F.concat(host_of(url), path_of(url)).alias("a"), F.concat(host_of(F.col("to")), path_of(F.col("to"))).alias("b")).where("a != b").distinct()
    )


def judge(pages: DataFrame, rules=None, edges: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, via_alias`` for each page.  ``edges(a, b)``: further aliases, as host and path in one."""
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("own", rule_for(F.col("host"), F.col("path"), rules)).withColumn("address", F.concat("host", "path"))
    links = settle(alias_edges(pages) if edges is None else alias_edges(pages).union(edges.select("a", "b")).distinct())
    groups = components(links)
    address = F.col("id")
    host, path = F.regexp_extract(address, "^[^/]*", 0), F.regexp_extract(address, "^[^/]*(.*)$", 1)
    members = groups.withColumn("verdict", rule_for(host, path, rules)["verdict"])
    blocked = members.where("verdict = 'block'").select("component").distinct()
    aliases = members.join(blocked, "component", "left_semi").select(F.col("id").alias("address")).distinct().withColumn("aliased", F.lit(True))
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("aliased"), F.lit("block")), F.lit("allow"))
    return judged.join(aliases, "address", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), (F.col("own").isNull() & F.coalesce("aliased", F.lit(False))).alias("via_alias"))


def oracle_sql() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "substr({0}, strpos({0}, '://') + 3)"

    def host(u: str) -> str:
        return f"CASE WHEN strpos({u}, '://') > 0 THEN {low.format(f"regexp_extract({rest.format(u)}, '^[^/?#]*')")} ELSE '' END"

    def path(u: str) -> str:
        return f"CASE WHEN strpos({u}, '://') > 0 THEN regexp_extract({rest.format(u)}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"

    fits = lambda h, p: "CASE " + " ".join(f"WHEN ({h} = '{n}' OR {h} LIKE '%.{n}') AND starts_with({p}, '{s}') THEN '{n}{s}'" for n, s, _ in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))) + " END"
    verdict = lambda r: "CASE " + " ".join(f"WHEN {r} = '{n}{s}' THEN '{v}'" for n, s, v in RULES) + " END"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {host("url")} AS host, {path("url")} AS path FROM pages),
tags AS (SELECT url, host, unnest([regexp_extract(regexp_extract(html, {quote(CANONICAL)}), {quote(HREF)}, 1),
                                   regexp_extract(regexp_extract(html, {quote(REFRESH)}), {quote(TARGET)}, 1)]) AS t FROM p WHERE strpos(url, '://') > 0),
full_tags AS (SELECT url, CASE WHEN starts_with(t, '//') THEN split_part(url, '://', 1) || ':' || t
                               WHEN starts_with(t, '/') THEN split_part(url, '://', 1) || '://' || host || t ELSE t END AS t FROM tags WHERE t <> ''),
e AS (SELECT DISTINCT {host("url")} || {path("url")} AS a, {host("t")} || {path("t")} AS b FROM full_tags WHERE strpos(t, '://') > 0),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT DISTINCT a AS v FROM s),
bad AS (SELECT v FROM (SELECT v, {fits("regexp_extract(v, '^[^/]*')", "regexp_extract(v, '^[^/]*(.*)$', 1)")} AS r FROM n) WHERE {verdict("r")} = 'block'),
reached(v) AS (SELECT v FROM bad UNION SELECT s.b FROM reached JOIN s ON s.a = reached.v),
own AS (SELECT page_id, host, path, {fits("host", "path")} AS rule FROM p)
SELECT page_id, host, path, rule, coalesce({verdict("rule")}, CASE WHEN host || path IN (SELECT v FROM reached) THEN 'block' END, 'allow') AS verdict,
       rule IS NULL AND host || path IN (SELECT v FROM reached) AS via_alias
FROM own"""
