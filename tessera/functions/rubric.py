"""Where findings belong: categories by detector, type and keyword; severities from numbers; completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring as S

#: Categories of detectors.
DETECTORS = {
    "correctness": "mutation_hazards exception_issues resource_leaks unawaited_coroutines async_issues global_state return_issues duplicate_definitions ai_scaffolding",
    "security": "security tsconfig secrets", "tests": "untested_modules test_smells coverage", "complexity": "complexity code_smells loop_simplifications",
    "design": "design_smells overengineering pattern_issues coupling parameter_objects boolean_params import_cycles module_issues local_imports encapsulation",
    "duplication": "duplicates dead_code comment_smells", "hygiene": "dependency_issues outdated_idioms naming_issues missing_docstrings type_gaps debug_leftovers unpythonic hygiene",
}
#: Categories of the language-blind detectors' finding types.  Frameworks' own types come as a table (``types``).
TYPES = {
    "correctness": "merge_conflict_marker", "security": "private_key_material cloud_credential hardcoded_secret_assignment committed_env_file",
    "complexity": "oversized_file oversized_line decision_density nesting_depth long_function high_arity", "duplication": "exact_duplicate near_duplicate zero_inbound_file dead_function_candidate commented_out_code",
    "design": "import_cycle god_module low_directory_cohesion change_coupling changes_with_everything", "tests": "untested_directory low_test_ratio test_asserts_nothing",
    "hygiene": "todo_inventory large_committed_binary single_author_file departed_author hotspot",
}
#: Keywords at a word's start, in order; the first that fits decides.
KEYWORDS = [
    ("n_plus_one", "correctness"), ("race", "correctness"), ("leak", "correctness"), ("unawaited", "correctness"), ("await", "correctness"), ("mutation", "correctness"), ("exception", "correctness"), ("swallow", "correctness"),
    ("secret", "security"), ("csrf", "security"), ("xss", "security"), ("injection", "security"), ("permission", "security"), ("auth", "security"), ("insecure", "security"), ("security", "security"), ("unsafe", "security"),
    ("test", "tests"), ("coverage", "tests"), ("assert", "tests"), ("mock", "tests"), ("complex", "complexity"), ("nesting", "complexity"), ("long_", "complexity"), ("god_", "complexity"), ("fat_", "complexity"), ("too_many", "complexity"),
    ("duplicate", "duplication"), ("dead_", "duplication"), ("unused", "duplication"), ("commented", "duplication"), ("cycle", "design"), ("coupling", "design"), ("envy", "design"), ("overengineer", "design"), ("abstract", "design"),
    ("wrapper", "design"), ("factory", "design"), ("singleton", "design"), ("deprecat", "hygiene"), ("idiom", "hygiene"), ("naming", "hygiene"), ("docstring", "hygiene"), ("dependency", "hygiene"), ("annotation", "hygiene"),
]
#: Evidence whose incompleteness takes a category's grade away.
GATES = {"reference_graph": "design", "test_classification": "tests", "history": "hygiene"}


def by_name(table: dict[str, str]) -> dict[str, str]:
    return {name: category for category, names in table.items() for name in names.split()}


def by_keyword(token: Column) -> Column:
    """The category of the first keyword, in the list's order, that begins a word: at the token's start, or after what is neither letter nor digit."""
    needles = [n for n, _ in KEYWORDS]
    hits = F.regexp_extract_all(F.lower(token), F.lit(rf"(?<![\p{{L}}\p{{N}}])({'|'.join(needles)})"), F.lit(1))
    first = F.array_min(F.transform(hits, lambda x: F.array_position(F.array(*map(F.lit, needles)), x)))
    return F.get(F.array(*(F.lit(c) for _, c in KEYWORDS)), (first - 1).cast("int"))


def categorize(detector: Column, kind: Column, types: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(category, matched): by detector, by type, by a keyword of the type, by one of the detector, else the fallback, unmatched."""
    table = lambda names: F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    found = F.coalesce(F.try_element_at(table(by_name(DETECTORS)), detector), F.try_element_at(table(by_name(TYPES) | (types or {})), kind), by_keyword(kind), by_keyword(F.nullif(detector, F.lit(""))))
    return F.coalesce(found, F.lit(S.FALLBACK)), found.isNotNull()


def ratio_severity(value: Column, threshold: Column) -> Column:
    ratio = value / threshold
    return F.when(ratio >= 2.0, "high").when(ratio >= 1.5, "medium").otherwise("low")


def metric_grade(value: Column, medium: Column, high: Column) -> Column:
    """high, medium, or null below both."""
    return F.when(value >= high, "high").when(value >= medium, "medium")


def confidence_severity(severity: Column, confidence: Column) -> Column:
    """The severity, or one from the confidence where there is none; medium without either."""
    return F.coalesce(severity, F.when(confidence >= 90, "high").when(confidence >= 70, "medium").when(confidence.isNotNull(), "low"), F.lit("medium"))


def effort(severity: Column) -> Column:
    return F.when(severity == "high", "M").otherwise("S")


def line_number(value: Column) -> Column:
    """A line as a number, whatever was emitted; 0 without one."""
    return F.coalesce(F.trim(value.cast("string")).try_cast("int"), F.lit(0))


def covered(reports: DataFrame) -> DataFrame:
    """``reports(report, ran array, skipped array, errored array, profile array)`` to ``category, graded``.

    A report speaks for what it ran, less what it skipped or failed in, and only within its profile; a category is graded where any
    report speaks for it.  Categories that were skipped and ran nowhere are listed ungraded.
    """
    own = F.array_intersect(F.array_except(F.array_except("ran", F.coalesce("skipped", F.array().cast("array<string>"))), F.coalesce("errored", F.array().cast("array<string>"))), "profile")
    spoken = reports.select(F.explode(own).alias("category")).distinct()
    named = reports.select(F.explode(F.array_union("ran", F.coalesce("skipped", F.array().cast("array<string>")))).alias("category")).distinct()
    return named.join(spoken.withColumn("graded", F.lit(True)), "category", "left").select("category", F.coalesce("graded", F.lit(False)).alias("graded"))


def skipped_everywhere(reports: DataFrame) -> DataFrame:
    """Categories that some report skipped and none ran."""
    return reports.select(F.explode("skipped").alias("category")).distinct().join(reports.select(F.explode("ran").alias("category")).distinct(), "category", "left_anti")


def without_incomplete(scores: DataFrame, completeness: DataFrame) -> DataFrame:
    """``scores(category, ...)`` less the categories whose evidence in ``completeness(block, adequate)`` was not adequate."""
    gates = F.create_map(*(F.lit(x) for pair in GATES.items() for x in pair))
    dropped = completeness.where("adequate = false").select(F.try_element_at(gates, F.col("block")).alias("category")).where("category is not null").distinct()
    return scores.join(dropped, "category", "left_anti")
