"""The fixed rubric: severities, categories, densities, scores and grades, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight and half-life (weighted findings per 1000 lines) of each category.
CATEGORIES = {"correctness": (25, 6), "security": (15, 2), "tests": (15, 8), "complexity": (15, 12), "design": (12, 10), "duplication": (10, 10), "hygiene": (8, 25)}
FALLBACK = "hygiene"
SEVERITIES = {"high": 10, "medium": 3, "low": 1}
BANDS = [(97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (63, "D"), (60, "D-")]
UNGRADED = "—"


def severity(value: Column) -> Column:
    """high, medium or low; anything else is medium."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*SEVERITIES), v).otherwise("medium")


def severity_weight(value: Column) -> Column:
    v = severity(value)
    return F.when(v == "high", 10).when(v == "low", 1).otherwise(3)


def severity_rank(value: Column) -> Column:
    v = severity(value)
    return F.when(v == "high", 0).when(v == "medium", 1).otherwise(2)


def finding_type(*keys: Column) -> Column:
    """The first of several keys that is neither null nor empty; 'issue' without one."""
    return F.coalesce(*(F.nullif(k, F.lit("")) for k in keys), F.lit("issue"))


def density(weighted: Column, loc: Column) -> Column:
    return weighted / F.greatest(loc, F.lit(1000)) * 1000


def score(value: Column, half_life: Column) -> Column:
    return F.when(value <= 0, F.lit(100.0)).otherwise(100 * F.pow(F.lit(0.5), value / half_life))


def grade(value: Column) -> Column:
    made = F.when(value.isNull(), UNGRADED)
    for least, letter in BANDS:
        made = made.when(value >= least, letter)
    return made.otherwise("F")


def weighted_mean(value: Column, weight: Column) -> Column:
    """An aggregate: the mean over rows whose value isn't null; null if none has one."""
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def grade_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '{UNGRADED}' " + " ".join(f"WHEN {value} >= {n} THEN '{g}'" for n, g in BANDS) + " ELSE 'F' END"
