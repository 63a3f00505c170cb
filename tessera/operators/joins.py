"""Joins: by unique suffix, by shortest suffix, by longest prefix, by range, and against a bag of known rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def unique_suffix_join(left: DataFrame, right: DataFrame, left_path: str = "raw_path", right_path: str = "path") -> DataFrame:
    """``left`` with ``matched``: the equal path, else the only path that ends in the longest of its suffixes that just one path ends in.

    Both sides are exploded to suffixes and joined on them: equi-joins, and never more rows than paths have parts.
    """
    exact = right.select(F.col(right_path).alias("_exact")).distinct()
    ends = right.select(F.col(right_path).alias("_path")).distinct().select("_path", F.explode(T.suffixes(F.col("_path"))).alias("_suffix"))
    only = ends.groupBy("_suffix").agg(F.count("*").alias("_n"), F.min("_path").alias("_path")).where("_n = 1").select("_suffix", "_path")
    mine = left.select(left_path).distinct().select(left_path, F.posexplode(T.suffixes(F.col(left_path))).alias("_cut", "_suffix"))
    best = mine.join(only, "_suffix").groupBy(left_path).agg(F.min_by("_path", "_cut").alias("_unique"))
    joined = left.join(best, left_path, "left").join(exact, F.col(left_path) == F.col("_exact"), "left")
    return joined.select(*left.columns, F.coalesce("_exact", "_unique").alias("matched"))


def shortest_suffix_join(left: DataFrame, right: DataFrame, left_path: str = "cited", right_path: str = "path") -> DataFrame:
    """``left`` with ``matched``: the shortest path that ends in the cited one on a part bound; ties by name."""
    ends = right.select(F.col(right_path).alias("_path")).distinct().select("_path", F.explode(T.suffixes(F.col("_path"))).alias("_suffix"))
    best = ends.groupBy("_suffix").agg(F.min(F.struct(F.length("_path").alias("n"), F.col("_path").alias("p"))).alias("_m"))
    return left.join(best, F.col(left_path) == F.col("_suffix"), "left").select(*left.columns, F.col("_m.p").alias("matched"))


def longest_prefix_join(left: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """``left`` with ``matched``: the longest prefix, in whole parts, of the path (the path itself included)."""
    own = F.concat(T.ancestors(F.col(path)), F.array(F.col(path)))
    mine = left.select(path).distinct().select(path, F.posexplode(own).alias("_depth", "_prefix"))
    best = mine.join(prefixes.select(F.col(prefix).alias("_prefix")).distinct(), "_prefix").groupBy(path).agg(F.max_by("_prefix", "_depth").alias("matched"))
    return left.join(best, path, "left")


def range_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, stop: str, width: int = 64) -> DataFrame:
    """Points inside spans (both ends count) of the same key.  Spans are exploded to cells of ``width``, so the join has equal keys only."""
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    return points.withColumn("_cell", F.floor(F.col(at) / width)).join(cells, [key, "_cell"]).where(F.col(at).between(F.col(start), F.col(stop))).drop("_cell")


def bag_anti_join(left: DataFrame, baseline: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``left`` beyond as many with the same key as the baseline has; the first, in ``order``, are taken as known."""
    known = baseline.groupBy(*keys).agg(F.count("*").alias("_known"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_b_{k}"))
        condition = same if condition is None else condition & same
    renamed = known.select(*(F.col(k).alias(f"_b_{k}") for k in keys), "_known")
    return left.withColumn("_rank", rank).join(renamed, condition, "left").where(F.col("_rank") > F.coalesce("_known", F.lit(0))).select(*left.columns)


def first_match(pairs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def map_lines(points: DataFrame, hunks: DataFrame, key: str) -> DataFrame:
    """``points(key, file, line)`` to ``key, base_line``: the line before the hunks ``(file, s, n, old)`` changed the file; null inside a hunk.

    A hunk replaces ``old`` lines by the ``n`` lines from ``s`` on.  One shuffle by file and one sorted pass.
    """
    none = F.lit(None)
    kind = points.schema[key].dataType
    starts = hunks.select("file", F.col("s").alias("at"), F.lit(0).alias("kind"), none.cast(kind).alias(key), (F.col("s") + F.col("n")).alias("end"), F.lit(0).cast("long").alias("shift"))
    ends = hunks.select("file", (F.col("s") + F.col("n")).alias("at"), F.lit(0).alias("kind"), none.cast(kind).alias(key), none.cast("long").alias("end"), (F.col("n") - F.col("old")).cast("long").alias("shift"))
    asked = points.select("file", F.col("line").alias("at"), F.lit(1).alias("kind"), key, none.cast("long").alias("end"), none.cast("long").alias("shift"))
    so_far = Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    made = starts.unionByName(ends).unionByName(asked).withColumn("reach", F.max("end").over(so_far)).withColumn("moved", F.sum("shift").over(so_far)).where("kind = 1")
    return made.select(key, F.when(F.coalesce(F.col("reach") > F.col("at"), F.lit(False)), None).otherwise(F.col("at") - F.coalesce("moved", F.lit(0))).alias("base_line"))


#: Items whose keys are compared inside a document's row, and items of fewer words than a key needs, at most.
IN_ROW, SHORT_ITEMS = 20_000, 10_000


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of each row of ``docs(doc_id, text)`` whose text holds that of a row of ``items(item_id, item)``.

    An item of at least six words is known by a hash of its words 2 to 5, which are whole words of any text that holds it; a document's
    hashes are compared in its row, and only candidates bring their text to ``contains``.  Shorter items are looked for one by one.
    """
    words = lambda c: F.filter(F.split(c, "[ \t\n\r]+"), lambda x: x != "")
    made = items.select("item_id", "item", words(F.col("item")).alias("w")).where("item is not null")
    long_ = made.where(F.size("w") >= 6).select("item_id", "item", F.xxhash64(*(F.get("w", F.lit(i)) for i in range(1, 5))).alias("key"))
    short = made.where(F.size("w") < 6).select("item_id", "item")
    w = words(F.col("text"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 4), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(4)))))
    wide = docs.select("doc_id", "text", w.alias("w")).where(F.size("w") >= 4).select("doc_id", "text", grams.alias("grams"))
    if long_.limit(IN_ROW + 1).count() <= IN_ROW:
        keys = F.broadcast(long_.agg(F.collect_set("key").alias("keys")))
        hits = wide.crossJoin(keys).select("doc_id", "text", F.explode(F.array_intersect("grams", "keys")).alias("key")).join(F.broadcast(long_), "key")  # one row of keys
    else:
        hits = wide.select("doc_id", "text", F.explode("grams").alias("key")).join(long_.select("key").distinct(), "key", "left_semi").join(long_, "key")
    found = hits.where(F.expr("contains(text, item)")).select("doc_id", "item_id")
    if (n := short.limit(SHORT_ITEMS + 1).count()) > SHORT_ITEMS:
        raise ValueError(f"more than {SHORT_ITEMS} items of under six words")
    if n:
        listed = F.broadcast(short.agg(F.collect_list(F.struct("item_id", "item")).alias("short")))
        few = docs.select("doc_id", "text").crossJoin(listed).select("doc_id", F.explode(F.filter("short", lambda x: F.contains(F.col("text"), x["item"]))).alias("x"))  # one row of items
        found = found.unionByName(few.select("doc_id", F.col("x.item_id").alias("item_id")))
    return found
