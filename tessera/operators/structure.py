"""What classes, types and files look like beside each other: cohesion, envy, equal shapes, regions, files nothing loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.imports import folder

#: A class is judged from so many methods and fields on; shares of pairs of methods that have no field in common.
LEAST_METHODS, LEAST_FIELDS, MEDIUM_SHARE, HIGH_SHARE = 4, 2, 0.8, 0.95
#: Touches of another object from which a method envies it, and how many times its own touches (one at least) they must exceed.
LEAST_TOUCHES, ENVY_RATIO = 4, 2
LEAST_MEMBERS, WINDOW = 3, 50


def low_cohesion(touches: DataFrame) -> DataFrame:
    """``class, disjoint, pairs, loners, severity`` of ``touches(class, method, field)``, the classes where most pairs of methods share no field.

    A method that touches none has a row with a null field.  A class's methods are one array, whose pairs are counted in the row.
    """
    methods = touches.groupBy("class", "method").agg(F.collect_set("field").alias("own"))
    classes = methods.groupBy("class").agg(F.collect_list("own").alias("sets")).where(F.size("sets") >= LEAST_METHODS).where(F.size(F.array_distinct(F.flatten("sets"))) >= LEAST_FIELDS)
    later = lambda i: F.slice("sets", i + 2, F.size("sets"))
    apart = F.transform("sets", lambda x, i: F.size(F.filter(later(i), lambda y: ~F.arrays_overlap(x, y))).cast("long"))
    n = F.size("sets").cast("long")
    counted = classes.select("class", F.aggregate(apart, F.lit(0).cast("long"), lambda a, b: a + b).alias("disjoint"), (n * (n - 1) / 2).cast("long").alias("pairs"), F.size(F.filter("sets", lambda x: F.size(x) == 0)).alias("loners"))
    share = F.col("disjoint") / F.col("pairs")
    return counted.where(share >= MEDIUM_SHARE).withColumn("severity", F.when(share < HIGH_SHARE, "medium").otherwise("high"))


def feature_envy(accesses: DataFrame) -> DataFrame:
    """``class, method, envied, touches, own`` of ``accesses(class, method, object, member)``; a null object is the class's own state.

    Own touches count different members, those of another object count all.  Of objects touched equally often, the first by name.
    """
    members = accesses.groupBy("class", "method", "object", "member").agg(F.count("*").alias("n"))
    objects = members.groupBy("class", "method", "object").agg(F.sum("n").alias("n"), F.count("*").alias("members"))
    most = F.min(F.when(F.col("object").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("object").alias("object"))))
    methods = objects.groupBy("class", "method").agg(most.alias("most"), F.coalesce(F.max(F.when(F.col("object").isNull(), F.col("members"))), F.lit(0)).alias("own"))
    named = methods.select("class", "method", F.col("most.object").alias("envied"), (-F.col("most.n")).alias("touches"), "own")
    return named.where((F.col("touches") >= LEAST_TOUCHES) & (F.col("touches") > ENVY_RATIO * F.greatest("own", F.lit(1))))


def same_shapes(types: DataFrame) -> DataFrame:
    """``shape, first, occurrences`` of ``types(ordinal, name, members array<struct<name, type>>)``: shapes that differently named types have.

    Blanks within a member's type don't count, nor does the order of members.  A shape's occurrences are counted, never collected.
    """
    spelled = F.array_join(F.transform(F.array_sort(F.transform("members", lambda m: F.struct(m["name"].alias("n"), F.replace(m["type"], F.lit(" "), F.lit("")).alias("t")))), lambda m: F.concat(m["n"], F.lit(":"), m["t"])), "|")
    shaped = types.where(F.size("members") >= LEAST_MEMBERS).select("ordinal", "name", spelled.alias("shape"))
    groups = shaped.groupBy("shape").agg(F.min_by("name", "ordinal").alias("first"), F.count("*").alias("occurrences"), F.min("name").alias("least"), F.max("name").alias("greatest"))
    return groups.where("least != greatest").select("shape", "first", "occurrences")


def regions(lines: Column, window: int = WINDOW) -> Column:
    """The lines, in order, that lie at least a window after the last one kept: each region of overlapping hits once."""
    return F.aggregate(F.array_sort(lines), F.slice(lines, 1, 0), lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= window), F.concat(kept, F.array(x))).otherwise(kept))


def orphans(paths: DataFrame, loaded: DataFrame, sources: DataFrame) -> DataFrame:
    """``path`` of files that nothing loads, in folders and with suffixes of ``loaded(path, asset)``'s assets; sources and dotted roots left out.

    ``loaded`` holds every path that something refers to; ``asset`` marks those that are data, whose folders and suffixes are known by it.
    """
    directory, ending = F.regexp_replace(folder(F.col("path")), "^/", ""), F.regexp_extract("path", r"\.([^.]*)$", 1)
    assets = loaded.where("asset").select(directory.alias("_dir"), ending.alias("_ending"), F.contains("path", F.lit(".")).alias("_dotted"))
    left = paths.where("path like '%.%' and path not like '.%'").select("path", directory.alias("_dir"), ending.alias("_ending")).distinct()
    left = left.join(loaded.select("path"), "path", "left_anti").join(sources.select("path"), "path", "left_anti")
    return left.join(assets.select("_dir").distinct(), "_dir", "left_semi").join(assets.where("_dotted").select("_ending").distinct(), "_ending", "left_semi").select("path")
