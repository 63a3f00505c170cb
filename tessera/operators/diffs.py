"""What a change weighs: its footprint by kind of file, and a risk score for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths as P

#: Weights of kinds of files; kinds whose lines aren't scored; a weight from which a kind is a reason by itself.
KIND_WEIGHTS = {"schema/migration": 3, "api-contract": 3, "dependencies": 2, "config": 2, "build/ci": 1, "source": 1, "test": 0, "docs": 0}
UNSCORED, REASON_FROM = ["test", "docs"], 2
#: Fixed values: (label, weight, pattern, whether case is ignored) of risky added lines.
RISKS = [
    ("security", 3, r"\b(auth|password|passwd|token|secret|credential|permission|privilege|jwt|oauth|csrf|cors|sanitiz|escape|crypt)\w*", True),
    ("injection-surface", 3, r"""\b(eval|exec)\s*\(|pickle\.loads|yaml\.load\s*\(|subprocess|shell\s*=\s*True|innerHTML|dangerouslySetInnerHTML|execute\s*\(\s*f?["'].*(SELECT|INSERT|UPDATE|DELETE)""", True),
    ("concurrency", 2, r"\b(lock|mutex|rlock|semaphore|atomic|threading|thread\b|goroutine|channel|volatile|synchronized|create_task|gather\s*\(|run_in_executor)", True),
    ("transactions", 2, r"\b(transaction|commit|rollback|savepoint|isolation)", True),
    ("error-swallowing", 3, r"except\s*(\w+\s*)?:\s*(pass|\.\.\.)\s*$|catch\s*\([^)]*\)\s*\{\s*\}|\.catch\(\s*\(\)\s*=>\s*\{?\s*\}?\s*\)", False),
    ("retries/timeouts", 1, r"\b(retry|retries|backoff|timeout|deadline)", True),
    ("caching", 1, r"\b(cache|memoiz|invalidat|ttl)\w*", True),
    ("feature-flag", 1, r"\b(feature.?flag|flag.?enabled|toggle|rollout)", True),
    ("todo-markers", 1, r"\b(TODO|FIXME|HACK|XXX)\b", False),
]
#: A signature that changed and one that went weigh so much; a file loses much from over so many lines, and over so many times its new ones, on.
CHANGED_SIGNATURE, REMOVED_SYMBOL, MANY_REMOVED, TIMES_ADDED = 3, 2, 50, 2


def files_of(lines: DataFrame) -> DataFrame:
    """``path, kind, adds, dels, <label>...`` of ``lines(path, tag, text)``: one aggregate over a diff's lines, generated documents left out.

    Tags are ``+`` and ``-``; other lines are context.  A null text fits no pattern.
    """
    added = F.col("tag") == "+"
    hits = [F.count_if(added & F.col("text").rlike(("(?iU)" if any_case else "(?U)") + pattern)).alias(label) for label, _, pattern, any_case in RISKS]
    by_path = lines.where(~P.is_generated_document(F.col("path"))).groupBy("path").agg(F.count_if(added).alias("adds"), F.count_if(F.col("tag") == "-").alias("dels"), *hits)
    return by_path.withColumn("kind", P.change_kind(F.col("path")))


def footprint(files: DataFrame) -> DataFrame:
    """``kind, files, adds, dels`` of what ``files_of`` gives."""
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.sum("adds").alias("adds"), F.sum("dels").alias("dels"))


def _repeats(count: Column, weight: int) -> Column:
    """A pattern counts once or twice, however often it occurs."""
    return F.least(count, F.lit(2)) * weight


def risk(files: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """``path, kind, adds, dels, score, reasons`` of what ``files_of`` gives, the riskiest and then the largest first.

    ``signatures(path, changed, removed)``: how many definitions of a file changed or went; they count in source files.  Reasons follow the
    order kind, patterns as listed, signatures, removal.
    """
    f = files if signatures is None else files.join(signatures.select("path", "changed", "removed"), "path", "left")
    own = lambda c: F.when(F.col("kind") == "source", F.coalesce(F.col(c), F.lit(0))).otherwise(0) if signatures is not None else F.lit(0)
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in KIND_WEIGHTS.items() for x in pair)), F.col("kind"))
    scored = ~F.col("kind").isin(UNSCORED)
    emptied = (F.col("dels") > MANY_REMOVED) & (F.col("dels") > TIMES_ADDED * F.col("adds"))
    score = weight + F.when(scored, sum((_repeats(F.col(f"`{label}`"), w) for label, w, *_ in RISKS), F.lit(0))).otherwise(0)
    score = score + F.when(own("changed") > 0, CHANGED_SIGNATURE).otherwise(0) + F.when(own("removed") > 0, REMOVED_SYMBOL).otherwise(0) + emptied.cast("int")
    named = lambda label, n: F.when(n > 0, F.concat(F.lit(label + "×"), n.cast("string")))
    reasons = F.array_compact(F.array(
        F.when(weight >= REASON_FROM, F.col("kind")), *(F.when(scored, named(label, F.col(f"`{label}`"))) for label, *_ in RISKS),
        named("signature-change", own("changed")), named("removed-symbol", own("removed")), F.when(emptied, "large-removal"),
    ))
    return f.select("path", "kind", "adds", "dels", score.cast("long").alias("score"), reasons.alias("reasons")).orderBy(F.desc("score"), F.desc(F.col("adds") + F.col("dels")), "path")
