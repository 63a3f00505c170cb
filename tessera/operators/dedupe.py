"""Set operations on findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as S


def identity_path(path):
    """A path with forward slashes and without './' before it."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def max_multiplicity(findings: DataFrame, report: str = "report", identity: tuple[str, ...] = ("file", "line", "type"), ordinal: str = "ordinal", severity: str = "severity", order: str | None = None) -> DataFrame:
    """One report's rows for each identity: of the report with most of them, then with the harshest, then the earliest.

    Copies within that report all stay, so the kept count is the largest of any one report, neither one nor the sum.  ``order``: a
    column by which reports come one after the other (their names without it).  ``first_seen``: the (order, ordinal) of the identity's
    first finding.  One shuffle by identity.
    """
    by_report = F.col(order or report)
    own, all_ = Window.partitionBy(*identity, report), Window.partitionBy(*identity)
    counted = findings.withColumn("_n", F.count("*").over(own)).withColumn("_worst", F.min(S.severity_rank(F.col(severity))).over(own))
    rank = F.struct(-F.col("_n"), F.col("_worst"), by_report, F.col(report))
    first = F.struct(by_report.alias("report"), F.col(ordinal).alias("ordinal"))
    best = counted.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(all_)).withColumn("first_seen", F.min(first).over(all_))
    return best.where("_rank = _best").select(*findings.columns, "first_seen")


def attributed(reports: dict[str, DataFrame], name: str = "doctor") -> DataFrame:
    """All reports' rows, each with its report's name; nothing is dropped."""
    made = None
    for key, df in reports.items():
        rows = df.withColumn(name, F.lit(key))
        made = rows if made is None else made.unionByName(rows, allowMissingColumns=True)
    if made is None:
        raise ValueError("no reports")
    return made


def first_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).where("_n = 1").drop("_n")
