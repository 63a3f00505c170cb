"""History and diffs as text, to rows.

``touches`` reads ``git log --name-only --no-merges --format=@@%H%x09%cI%x09%an``; ``diff_lines`` and ``changed_lines`` read unified diffs.
Texts come in a column, one log or diff a row, so that many repositories are read at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def touches(logs: DataFrame, prefix: str = "") -> DataFrame:
    """``logs(repo, text)`` to ``repo, sha, author, ts, path``; with a prefix only paths below it, relative to it."""
    commit = logs.select("repo", F.explode(F.split("text", "(?m)^@@")).alias("c"))
    lines = F.split("c", "\r?\n")
    head = F.split(F.element_at(lines, 1), "\t")
    named = commit.where(F.size(head) >= 3).select("repo", head[0].alias("sha"), head[2].alias("author"), head[1].try_cast("timestamp").alias("ts"), F.explode(F.slice(lines, 2, F.size(lines))).alias("path"))
    below = named.where((F.col("path") != "") & F.col("path").startswith(prefix))
    return below.withColumn("path", F.substring("path", len(prefix) + 1, 1 << 30)).distinct()


def changed_since(touched: DataFrame, since: Column) -> DataFrame:
    return touched.where(F.col("ts") >= since).select("repo", "path").distinct()


def last_updated(touched: DataFrame, prefix: str) -> DataFrame:
    return touched.where(F.col("path").startswith(prefix)).groupBy("repo").agg(F.max("ts").alias("ts"))


def depth(touched: DataFrame, min_commits: int = 20) -> DataFrame:
    """``repo, commits, first_ts, enough``: whether the history is deep enough to rank by churn."""
    return touched.groupBy("repo").agg(F.countDistinct("sha").alias("commits"), F.min("ts").alias("first_ts")).withColumn("enough", F.col("commits") >= min_commits)


def _plain(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, '^"|"$', ""), "^[ab]/", "")


def diff_files(diffs: DataFrame) -> DataFrame:
    """``diffs(diff_id, text)`` to ``diff_id, file_no, path, old_path, status, binary, hunks``; status A, D, R or M."""
    files = diffs.select("diff_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "(?m)^diff --git ")).alias("file_no", "body")).where("file_no > 0")
    parts = F.split("body", r"(?m)^(?=@@ -)")
    h = files.select("diff_id", "file_no", parts[0].alias("head"), F.slice(parts, 2, F.size(parts)).alias("hunks"))
    got = lambda pattern: F.nullif(F.trim(F.regexp_extract("head", pattern, 1)), F.lit(""))
    minus, plus = got(r"(?m)^--- ([^\n\t]*)"), got(r"(?m)^\+\+\+ ([^\n\t]*)")
    status = F.when(F.col("head").rlike(r"(?m)^new file"), "A").when(F.col("head").rlike(r"(?m)^deleted file") | (plus == "/dev/null"), "D").when(F.col("head").rlike(r"(?m)^rename to "), "R").otherwise("M")
    old = F.when(minus == "/dev/null", "").otherwise(F.coalesce(got(r"(?m)^rename from ([^\n]*)"), _plain(minus), got(r'^"?a/([^\n]*?)"? "?b/')))
    new = F.coalesce(got(r"(?m)^rename to ([^\n]*)"), F.when(plus != "/dev/null", _plain(plus)), F.when(plus == "/dev/null", _plain(minus)), got(r'^"?a/[^\n]*?"? "?b/([^\n]*?)"?\n'))
    binary = F.col("head").rlike(r"(?m)^(Binary files|GIT binary patch)")
    return h.select("diff_id", "file_no", new.alias("path"), old.alias("old_path"), status.alias("status"), binary.alias("binary"), "hunks").where("path is not null")


def diff_lines(diffs: DataFrame) -> DataFrame:
    """``diff_id, path, old_path, status, hunk_no, new_start, line_no, tag, text, new_line``; ``new_line`` is null for removed lines."""
    hunk = diff_files(diffs).select("diff_id", "file_no", "path", "old_path", "status", F.posexplode("hunks").alias("hunk_no", "h"))
    hunk = hunk.withColumn("new_start", F.regexp_extract("h", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int"))
    rows = F.split("h", "\n")
    line = hunk.select("diff_id", "file_no", "path", "old_path", "status", "hunk_no", "new_start", F.posexplode(F.slice(rows, 2, F.size(rows))).alias("line_no", "raw")).withColumn("tag", F.substring("raw", 1, 1)).where("tag in ('+', '-', ' ')")
    kept = (F.col("tag") != "-").cast("int")
    w = Window.partitionBy("diff_id", "file_no", "hunk_no").orderBy("line_no")
    at = F.when(F.col("tag") != "-", F.col("new_start") + F.sum(kept).over(w) - 1).cast("int")
    return line.withColumn("new_line", at).select("diff_id", "path", "old_path", "status", "hunk_no", "new_start", "line_no", "tag", F.expr("substring(raw, 2)").alias("text"), "new_line")


def changed_lines(diffs: DataFrame) -> DataFrame:
    """``diff_id, path, line`` of added lines."""
    return diff_lines(diffs).where("tag = '+'").select("diff_id", "path", F.col("new_line").alias("line"))
