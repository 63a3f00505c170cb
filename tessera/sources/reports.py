"""Detectors' reports to finding rows, and back to JSON.

Four shapes are known: a list of findings, ``{"categories": {name: {"issues": [...]}}}``, ``{"issues": [...]}`` and ``{"completeness": ...,
"findings": [...]}``.  Anything else has a row in ``statuses`` that says what is wrong with it: an empty or strange report is unknown,
never clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["file string", "line int", "severity string", "description string", "suggestion string", "smell_type string", "category string", "kind string"]


def _list(path: str) -> Column:
    return F.expr(f"try_variant_get(v, '{path}', 'array<variant>')")


def _shaped(reports: DataFrame) -> DataFrame:
    v = reports.select("source", "text", F.try_parse_json("text").alias("v"))
    kind = F.schema_of_variant("v")
    has_categories = F.schema_of_variant(F.expr("try_variant_get(v, '$.categories', 'variant')")).startswith("OBJECT")
    shape = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.col("v").isNull(), "parse error").when(kind.startswith("ARRAY"), "list")
        .when(has_categories, "categories").when(_list("$.findings").isNotNull(), "findings").when(_list("$.issues").isNotNull(), "issues").otherwise("unknown")
    )
    return v.withColumn("shape", shape)


def statuses(reports: DataFrame) -> DataFrame:
    """``reports(source, text)`` to ``source, shape, readable``; shape: one of the four, or ``empty``, ``parse error``, ``unknown``."""
    return _shaped(reports).select("source", "shape", (~F.col("shape").isin("empty", "parse error", "unknown")).alias("readable"))


def findings(reports: DataFrame) -> DataFrame:
    """``reports(source, text)`` to ``source, file, line, severity, ...``: entries that aren't objects are left out.

    A finding without a category takes the one it is listed under.  Candidates are rows with ``kind`` candidate.
    """
    v = _shaped(reports)
    flat = F.when(F.col("shape") == "list", _list("$")).when(F.col("shape") == "findings", _list("$.findings")).when(F.col("shape") == "issues", _list("$.issues"))
    plain = v.select("source", F.lit(None).cast("string").alias("under"), F.explode(flat).alias("f"))
    named = v.where("shape = 'categories'").select("source", F.from_json("text", "struct<categories:map<string,variant>>")["categories"].alias("c")).select("source", F.explode("c").alias("under", "v"))
    each = plain.union(named.select("source", "under", F.explode(_list("$.issues")).alias("f"))).where(F.schema_of_variant("f").startswith("OBJECT"))
    got = {name: F.expr(f"try_variant_get(f, '$.{name}', '{kind}')").alias(name) for name, kind in map(str.split, FIELDS)}
    got["category"] = F.coalesce(got["category"], "under").alias("category")
    return each.select("source", *got.values())


def write_findings(found: DataFrame, path: str) -> None:
    """JSON lines, one finding each; null fields are left out.  An existing path is an error."""
    found.write.json(path)


def as_lines(found: DataFrame) -> DataFrame:
    """``line``: findings as text, ``file:line: [severity] description``; no number where there is none."""
    at = F.concat_ws(":", "file", F.col("line").cast("string"))
    return found.select(F.concat(at, F.lit(": ["), F.coalesce("severity", F.lit("medium")), F.lit("] "), F.coalesce("description", F.lit(""))).alias("line"))
