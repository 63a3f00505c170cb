"""Labelled datasets in JSONL, JSON, CSV and TSV: rows, bad rows and, for every field, how many rows fill it.

Every row is counted and parsed; there is no cap.  A value is filled unless it is null, an empty text, an empty list or an empty object;
zero and false are values.  Blank lines of JSONL are no rows.  A file of another shape appears with ``status`` saying so, never as empty data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: fields that hold ground truth
LABEL_FIELDS = [
    "expected", "expected_answer", "expected_output", "expected_result", "ground_truth",
    "groundtruth", "gold", "gold_answer", "gold_passage", "gold_label", "label", "labels",
    "correct_answer", "correct", "target", "targets", "reference",
    "references", "y_true", "ytrue", "truth", "human_score", "human_label",
    "human_rating", "annotation", "annotations", "rating", "relevance", "relevant",
    "is_correct", "verdict",
]
# fixed values: keys under which a JSON object holds its records
RECORD_KEYS = ["data", "examples", "rows", "records", "cases", "items", "tests", "samples", "results", "questions", "evals", "dataset"]
EMPTY = ["null", '""', "[]", "{}"]


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``file, record``: one row a line with text; ``record`` is null for lines that aren't JSON objects."""
    line = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,ndjson}").text(path)
    parsed = line.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    return parsed.select("file", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")).alias("record"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """``file, status, records``: status ``records``, ``not a dataset`` or ``parse error``; a list of variants, null but for the first.

    Records are a list that holds an object, or the first filled list under a record key, else the first empty one, else one labelled object.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    v = text.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    lists = [F.expr(f"try_variant_get(v, '$.{k}', 'array<variant>')") for k in RECORD_KEYS]
    is_list, is_object = F.schema_of_variant("v").startswith("ARRAY"), F.schema_of_variant("v").startswith("OBJECT")
    objects = lambda a: F.exists(a, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    whole = F.expr("try_variant_get(v, '$', 'array<variant>')")
    labelled = reduce(lambda a, b: a | b, [~F.coalesce(F.expr(f"to_json(try_variant_get(v, '$.{k}', 'variant'))"), F.lit("null")).isin(EMPTY) for k in LABEL_FIELDS])
    records = F.when(is_list & objects(whole), whole).when(
        is_object, F.coalesce(*[F.when(objects(a), a) for a in lists], *[F.when(F.size(a) == 0, a) for a in lists], F.when(labelled, F.array("v")))
    )
    made = v.withColumn("records", records)
    status = F.when(F.col("v").isNull(), "parse error").when(F.col("records").isNull(), "not a dataset").otherwise("records")
    return made.select("file", status.alias("status"), "records")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record`` of JSON files; ``record`` is null for entries that aren't objects."""
    each = json_documents(spark, path).select("file", F.explode("records").alias("r"))
    return each.select("file", F.when(F.schema_of_variant("r").startswith("OBJECT"), F.col("r")).alias("record"))


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """One file with a header: its columns as strings, and ``_extra``, which is null unless a row has more fields than the header.

    Empty fields are null, also in ``_extra``: a row whose only surplus is one empty field isn't told apart.  An open quote runs to the end.
    """
    plain = spark.read.option("sep", sep).option("multiLine", True).option("escape", '"')
    names = plain.option("header", True).csv(path).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names) + ", `_extra` string"
    return plain.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def counts(records: DataFrame) -> DataFrame:
    """``file, rows, bad_rows`` of ``file, record``."""
    return records.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.col("record").isNull()).alias("bad_rows"))


def field_counts(records: DataFrame) -> DataFrame:
    """``file, field, n, is_label``: how many records fill each field; each field keeps its own n."""
    records.createOrReplaceTempView("tessera_records")
    each = records.sparkSession.sql("SELECT file, f.key AS field, to_json(f.value) AS value FROM tessera_records, LATERAL variant_explode(record) AS f WHERE record IS NOT NULL")
    filled = each.groupBy("file", "field").agg(F.count_if(~F.coalesce("value", F.lit("null")).isin(EMPTY)).alias("n"))
    return filled.select("file", "field", "n", F.lower("field").isin(LABEL_FIELDS).alias("is_label"))
