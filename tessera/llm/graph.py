"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins, so a vertex with very many links costs no more than its links; nothing is collected
into one task or the driver.  Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, settle


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)``, undirected, of any ordered type, to ``(id, component)``: the least vertex that links reach.

    Loops, repeated edges and edges with a null end are ignored; vertices with no other edge don't appear.  An empty input gives no rows.
    """
    at = settle(_canonical(edges))
    mark = _mark(at)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        after = settle(_small_star(_large_star(at)))
        now = _mark(after)
        discard(at)
        at, before, mark = after, mark, now
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    kind = at.schema["a"].dataType
    return at.select(F.col("a").alias("id"), F.col("b").alias("component")).union(at.select(F.col("b").cast(kind).alias("id"), F.col("b").alias("component")).distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Equal marks: equal edge sets, but for a chance of 2 to the -64."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
