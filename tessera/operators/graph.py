"""Dependency graphs: closure, strongly connected components, fan-in and fan-out, folder roll-ups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def kept(df: DataFrame) -> DataFrame:
    """Written to the folder that spark.checkpoint.dir names (one of our own for a local master without) and read back: the lineage ends here."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    path = f"{root.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_own: dict[str, str] = {}


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``src, dst, depth``: all pairs that a path joins, with the least number of edges (semi-naive rounds; its size is that of the answer).

    ``max_depth``: paths of at most so many edges only; without it, rounds go on until nothing is new.
    """
    step = edges.where("src != dst").select("src", "dst").distinct()
    found = kept(step.withColumn("depth", F.lit(1)))
    fresh = found
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        longer = fresh.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        fresh = kept(longer.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if not fresh.head(1):
            break
        found = kept(found.unionByName(fresh))
    return found


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component, size`` of strongly connected components with more than one vertex, by forward and backward colours.

    Each round gives every vertex the least vertex that reaches it, then keeps those that also reach that vertex inside the colour; the rest
    goes on to the next round.  Rows follow the edges, never the pairs of a closure.
    """
    left = kept(edges.where("src != dst").select("src", "dst").distinct())
    done = None
    while True:  # each round takes out the component of every colour's least vertex
        left = _trim(left)
        if not left.head(1):
            break
        colour = _spread(left, left.select(F.col("src").alias("v")).union(left.select("dst")).distinct().withColumn("c", F.col("v")))
        a, b = colour.toDF("src", "cs"), colour.toDF("dst", "cd")
        inside = kept(left.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "c")
        reached = _reach(back)
        sized = reached.groupBy("c").agg(F.count("*").alias("size"))
        part = kept(reached.join(sized.where("size > 1"), "c").select("v", "c", "size"))
        done = part if done is None else done.unionByName(part)
        gone = reached.select("v")
        left = kept(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"))
    if done is None:
        done = left.select(F.col("src").alias("v"), F.col("src").alias("c"), F.lit(0).cast("long").alias("size")).limit(0)
    return done.select(F.col("v").alias("vertex"), F.col("c").alias("component"), "size")


def _trim(edges: DataFrame) -> DataFrame:
    """Without vertices that have no edge in or none out, which are in no cycle."""
    n = edges.count()
    while True:
        edges = kept(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        if (now := edges.count()) == n:
            break
        n = now
    return edges


def _spread(edges: DataFrame, colours: DataFrame) -> DataFrame:
    at = kept(colours)
    while True:
        sent = edges.join(at.toDF("src", "c"), "src").select(F.col("dst").alias("v"), "c")
        after = kept(at.unionByName(sent).groupBy("v").agg(F.min("c").alias("c")))
        changed = bool(after.join(at.withColumnRenamed("c", "old"), "v").where("c != old").head(1))
        at = after
        if not changed:
            break
    return at


def _reach(edges: DataFrame) -> DataFrame:
    """``v, c``: the vertices that each colour's own vertex reaches inside the colour."""
    found = kept(edges.select("c").distinct().select(F.col("c").alias("v"), "c"))
    fresh = found
    while True:
        step = edges.join(fresh.withColumnRenamed("v", "src"), ["src", "c"]).select(F.col("dst").alias("v"), "c").distinct()
        fresh = kept(step.join(found, ["v", "c"], "left_anti"))
        if not fresh.head(1):
            break
        found = kept(found.unionByName(fresh))
    return found


def fans(edges: DataFrame) -> DataFrame:
    """``vertex, fan_in, fan_out``: different neighbours each way, loops left out; one shuffle of both ends."""
    e = edges.where("src != dst").select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("dst").alias("vertex"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("vertex"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    return ends.groupBy("x.vertex").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))


def dir_rollup(files: DataFrame, path: str = "path", loc: str = "loc") -> DataFrame:
    """``dir, own_loc, subtree_loc, files`` of every folder above a file ('' is the root)."""
    parent = F.regexp_replace(F.when(F.instr(F.col(path), "/") > 0, F.col(path)).otherwise(F.concat(F.lit("/"), F.col(path))), "/[^/]*$", "")
    each = files.select(F.explode(T.ancestors(F.col(path))).alias("dir"), parent.alias("parent"), F.col(loc).alias("loc"))
    return each.groupBy("dir").agg(F.sum(F.when(F.col("dir") == F.col("parent"), F.col("loc")).otherwise(0)).alias("own_loc"), F.sum("loc").alias("subtree_loc"), F.count("*").alias("files"))
