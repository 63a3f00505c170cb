"""Coverage artifacts to ``raw_path, covered, total``: Cobertura XML, LCOV, Go profiles.  Files without a counted line have no row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: artifact names in order of preference, with their kind
ARTIFACTS = [
    ("coverage.xml", "cobertura"),
    ("cobertura.xml", "cobertura"),
    ("cobertura-coverage.xml", "cobertura"),
    ("lcov.info", "lcov"),
    ("coverage.lcov", "lcov"),
    ("coverage.out", "go"),
]


def discover(paths: DataFrame, max_depth: int = 4) -> DataFrame:
    """``path, kind, preference`` of the artifacts among ``paths(path)``, relative to the root, best first."""
    known = paths.sparkSession.createDataFrame([(n, k, i) for i, (n, k) in enumerate(ARTIFACTS)], "name string, kind string, preference int")
    named = paths.where(F.size(F.split("path", "/")) <= max_depth).withColumn("name", F.lower(F.substring_index("path", "/", -1)))
    return named.join(F.broadcast(known), "name").select("path", "kind", "preference").orderBy("preference", "path")


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """A file's class entries add up; every line entry counts, those of methods too."""
    line = "array<struct<_hits:string>>"
    schema = f"_filename string, lines struct<line:{line}>, methods struct<method:array<struct<lines:struct<line:{line}>>>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    none = F.expr(f"cast(array() as {line})")
    lines = F.concat(F.coalesce("lines.line", none), F.coalesce(F.flatten(F.transform("methods.method", lambda m: F.coalesce(m["lines"]["line"], none))), none))
    each = rows.where(F.coalesce("_filename", F.lit("")) != "").select(F.col("_filename").alias("raw_path"), F.explode(lines).alias("l"))
    return each.groupBy("raw_path").agg(F.count_if(F.expr("try_cast(l._hits as long) > 0")).alias("covered"), F.count("*").alias("total"))


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """The last record of a file wins."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    # a record ends with its end mark; what follows the last one is no record
    parts = text.select(F.split("text", "(?m)^end_of_record.*$").alias("p")).select(F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("n", "record"))
    starts = F.split("record", "(?m)^SF:")
    record = parts.where(F.size(starts) > 1).select("n", F.element_at(starts, -1).alias("r"))
    hits = F.regexp_extract_all("r", F.lit(r"(?m)^DA:([^\n]*)"), F.lit(1))
    made = record.select("n", F.trim(F.split_part("r", F.lit("\n"), F.lit(1))).alias("raw_path"), hits.alias("h")).where(F.size("h") > 0)
    covered = F.size(F.filter("h", lambda x: (F.size(F.split(x, ",")) >= 2) & ~F.trim(F.split_part(x, F.lit(","), F.lit(2))).isin("0", "-")))
    return made.groupBy("raw_path").agg(F.max_by(F.struct(covered.cast("long").alias("covered"), F.size("h").cast("long").alias("total")), "n").alias("x")).select("raw_path", "x.covered", "x.total")


def go_profile(spark: SparkSession, path: str) -> DataFrame:
    """Statements, not lines, are counted."""
    at = lambda i: F.regexp_extract(F.trim("value"), r"^([^:]+):\d+\.\d+,\d+\.\d+ (\d+) (\d+)$", i)
    rows = spark.read.text(path).select(at(1).alias("raw_path"), F.expr("1").alias("_"), at(2).alias("n"), at(3).alias("c")).where("raw_path <> ''").selectExpr("raw_path", "cast(n as long) n", "cast(c as long) c")
    return rows.groupBy("raw_path").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("covered"), F.sum("n").alias("total")).where("total > 0")
