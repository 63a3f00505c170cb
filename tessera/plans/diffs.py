"""Queries over a change.  Events stand for a diff's lines: each has a path by its user and a text from a list by its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import spec
from tessera.functions import paths as P
from tessera.operators import diffs as D
from tessera.plans.repository import FOLDERS, KIND_SQL, NAMES, pick, pick_sql, quoted

TEXTS = [
    "x = 1", "if authorize(user): pass", "eval (source)", "with lock:", "session.rollback()", "except ValueError: pass", "except:", "retry(3)", "TTL = 5", "featureFlag on", "# TODO later", "# todo later",
    "cursor.execute(f'select name from t')", "subprocess.run(cmd)", "promise.catch(() => {})", "catch (e) { }", "relock()", "await gather (a, b)", "toggle.rollout", "", None, "memoized", "deadlines", "threads",
]
LINES_SQL = f"""l AS (SELECT {pick_sql(FOLDERS, "user_id")} || '/' || {pick_sql(NAMES, f"user_id // {len(FOLDERS)}")} AS path, CASE WHEN event_id % 5 < 2 AND user_id % 3 > 0 THEN '+' WHEN event_id % 5 < 4 THEN '-' ELSE ' ' END AS tag,
  {pick_sql(TEXTS, "event_id // 5")} AS text FROM events)"""
HITS_SQL = ", ".join(f"""count(*) FILTER (tag = '+' AND regexp_matches(text, {quoted(p)}{", 'i'" if any_case else ""})) AS "{label}\"""" for label, _, p, any_case in D.RISKS)
CHANGED_SQL = f"""{LINES_SQL}, n AS (SELECT *, adds + dels AS size, regexp_extract(path, '[^/]*$') AS name, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1) AS ext FROM (
  SELECT path, count(*) FILTER (tag = '+') AS adds, count(*) FILTER (tag = '-') AS dels, {HITS_SQL} FROM l WHERE NOT regexp_matches(path, {quoted(P.GENERATED_DOCUMENT)}) GROUP BY path)),
d AS (SELECT *, {KIND_SQL} AS kind FROM n)"""


def changed(t):
    e, u = F.col("event_id"), F.col("user_id")
    tag = F.when((e % 5 < 2) & (u % 3 > 0), "+").when(e % 5 < 4, "-").otherwise(" ")
    return D.files_of(t.events.select(F.concat(pick(FOLDERS, u), F.lit("/"), pick(NAMES, F.floor(u / len(FOLDERS)))).alias("path"), tag.alias("tag"), pick(TEXTS, F.floor(e / 5)).alias("text")))


@spec("diff_footprint", f"WITH {CHANGED_SQL} SELECT kind, count(*) AS files, sum(adds)::BIGINT AS adds, sum(dels)::BIGINT AS dels FROM d GROUP BY kind")
def diff_footprint(t):
    return D.footprint(changed(t))


WEIGHT_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in D.KIND_WEIGHTS.items()) + " END"
SCORED_SQL = " + ".join(f'least({w} * "{label}", {2 * w})' for label, w, *_ in D.RISKS)
REASONS_SQL = ", ".join(f"""CASE WHEN kind NOT IN ('test', 'docs') AND "{label}" > 0 THEN '{label}×' || "{label}" END""" for label, *_ in D.RISKS)


@spec("diff_risk", f"""WITH {CHANGED_SQL} SELECT path, kind, adds, dels, ({WEIGHT_SQL} + CASE WHEN kind IN ('test', 'docs') THEN 0 ELSE {SCORED_SQL} END + CASE WHEN dels > 50 AND dels > 2 * adds THEN 1 ELSE 0 END)::BIGINT AS score,
array_to_string(list_filter([CASE WHEN {WEIGHT_SQL} >= 2 THEN kind END, {REASONS_SQL}, CASE WHEN dels > 50 AND dels > 2 * adds THEN 'large-removal' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM d ORDER BY score DESC, size DESC, path""")
def diff_risk(t):
    return D.risk(changed(t)).withColumn("reasons", F.array_join("reasons", ", "))
