"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Each source is cut into blocks of ``block_rows`` rows in a hashed order, and a block is dealt in two halves, one a slot.  Slots come in
periods of Q.  In a period, a source with n of its Q slots has its j-th half (from 0) released at slot floor(j Q / n) and due before slot
ceil((j + 1) Q / n); earliest-deadline-first over one slot at a time keeps it within one half of n / Q times the elapsed slots.

A target weight isn't rounded: the slots up to the end of period p are the exact weights' cumulative sums, rounded
(``Schedule.upto``), so a period has now one slot more, now one less, and at a period's ends a source is at most one half away from its
target.  Both together: it is less than two halves, one block, away from weight times elapsed slots at any slot, in the first period and in
the millionth, for as long as it has blocks.  A slot whose source has run out stays empty, so every row is kept.

A row's slot follows from its source and its half alone, so tasks plan the periods that their rows fall into, each on its own; the driver
has a row for each source, ``MAX_SOURCES`` at most.  No task holds a whole source: rows are ranked within (source, hash range), and ranges
are offset by counted prefix sums.

Edge cases: a null source is a source of its own, and shares ``""`` with empty ones.  Null ids are kept; equal ids and repeated rows are
kept, each at its own place (in no fixed order among themselves).  Texts aren't looked at.  An empty table gives no rows.  Extra columns
pass through ``mix``; where one is called like a column made here, those made begin with one more underscore (``made_names``).
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: More sources, and weights under one in so many, aren't scheduled (``ValueError``).
MAX_SOURCES, LEAST_WEIGHT = 50_000, 1_000_000
MADE = ("mix_slot", "mix_block", "mix_release", "mix_deadline", "mix_in_block")


def period(shares: Mapping[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """EDF over one period of sum(shares) slots: for each source the (slot, release, deadline) of its blocks."""
    q = sum(shares.values())
    release = [(0, -(-q // n), name) for name, n in sorted(shares.items()) if n]
    heapq.heapify(release)
    due: list[tuple[int, str, int]] = []
    plan: dict[str, list[tuple[int, int, int]]] = {name: [] for name in shares}
    for slot in range(q):
        while release and release[0][0] <= slot:
            r, d, name = heapq.heappop(release)
            heapq.heappush(due, (d, name, r))
        d, name, r = heapq.heappop(due)
        assert slot < d, "Pfair: a block misses its deadline"
        plan[name].append((slot, r, d))
        j, n = len(plan[name]), shares[name]
        if j < n:
            heapq.heappush(release, (j * q // n, -(-(j + 1) * q // n), name))
    return plan


class Schedule:
    """The periods of exact target weights.  Equal arguments plan equal slots, wherever it is done."""

    def __init__(self, weights: tuple[tuple[str, Fraction], ...], slots_per_source: int = 64):
        total = sum(w for _, w in weights)
        self.names = [k for k, _ in weights]
        self.index = {k: i for i, k in enumerate(self.names)}
        least = min(w for _, w in weights) / total
        if least * LEAST_WEIGHT < 1:
            raise ValueError(f"a weight under one in {LEAST_WEIGHT}: {float(least)}")
        # so many slots that no source's cumulative share goes back from one period to the next
        self.q = 1 << max(6, (max(len(weights) * slots_per_source, -(-2 * least.denominator // least.numerator)) - 1).bit_length())
        self.sums, at = [Fraction(0)], Fraction(0)
        for _, w in weights:
            at += w / total
            self.sums.append(at)

    def upto(self, p: int) -> list[int]:
        """Each source's slots in the periods before ``p``: neighbours' differences of the rounded sums, which add up to p Q."""
        marks = [(2 * c.numerator * self.q * p + c.denominator) // (2 * c.denominator) for c in self.sums]
        return [b - a for a, b in zip(marks, marks[1:], strict=False)]

    def before(self, i: int, p: int) -> int:
        low, high = self.sums[i], self.sums[i + 1]
        return (2 * high.numerator * self.q * p + high.denominator) // (2 * high.denominator) - (2 * low.numerator * self.q * p + low.denominator) // (2 * low.denominator)

    def period_of(self, i: int, half: int) -> int:
        """The period in which the source's ``half`` falls."""
        w = self.sums[i + 1] - self.sums[i]
        p = max(0, int(Fraction(half) / (w * self.q)) - 2)
        while self.before(i, p + 1) <= half:
            p += 1
        return p

    @lru_cache(maxsize=512)  # noqa: B019  a schedule lives as long as its worker
    def plan(self, p: int) -> tuple[list[int], dict[str, list[tuple[int, int, int]]]]:
        """Halves before the period by source, and the period's (slot, release, deadline) by name, counted from its start."""
        first, then = self.upto(p), self.upto(p + 1)
        return first, period({k: b - a for k, a, b in zip(self.names, first, then, strict=True)})

    def place(self, name: str, half: int) -> tuple[int, int, int]:
        i = self.index[name]
        p = self.period_of(i, half)
        first, times = self.plan(p)
        return tuple(p * self.q + x for x in times[name][half - first[i]])


@lru_cache(maxsize=4)
def schedule(weights: tuple[tuple[str, Fraction], ...], slots_per_source: int) -> Schedule:
    return Schedule(weights, slots_per_source)


def exact(weights: Mapping[str, float]) -> tuple[tuple[str, Fraction], ...]:
    return tuple((k, Fraction(w)) for k, w in sorted(weights.items()))


def made_names(columns: list[str]) -> list[str]:
    """What ``mix`` calls its columns beside these: ``MADE``, with as many underscores before them as make them differ from all."""
    names = list(MADE)
    while {n.lower() for n in names} & {c.lower() for c in columns}:
        names = [f"_{n}" for n in names]
    return names


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = 64, temperature: float = 0.7, slots_per_source: int = 64, rows_per_range: int = 4096, seed: int = 17) -> DataFrame:
    """``docs`` with ``mix_slot, mix_block, mix_release, mix_deadline, mix_in_block``; sorting by (mix_slot, mix_in_block) gives the mixture.

    ``weights``: target weight by source name ("" for null); without it, sizes to the power ``temperature``.  A source that has no weight
    is a ``ValueError``: no rows are dropped without a word.  mix_block: the half block's number in its source; mix_in_block: the row's in it.
    """
    names = made_names(docs.columns)
    source = F.coalesce(F.col("source"), F.lit(""))
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = docs.select(source.alias("source"), key.alias("key"), F.col("doc_id").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    sizes = {r[0]: r[1] for r in docs.groupBy(source.alias("source")).agg(F.count("*")).limit(MAX_SOURCES + 1).collect()}  # a row for each source
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not sizes:
        return rows.select("doc.*", *(F.lit(0).cast("long").alias(c) for c in names))
    weights = {k: n**temperature for k, n in sizes.items()} if weights is None else dict(weights)
    if missing := sorted(set(sizes) - {k for k, w in weights.items() if w > 0}):
        raise ValueError(f"sources without a positive weight: {missing[:5]}")
    targets = exact({k: weights[k] for k in sizes})
    schedule(targets, slots_per_source)  # unfit weights are told here, not in a task
    spark, half_rows = docs.sparkSession, max(1, block_rows // 2)
    sent = spark.sparkContext.broadcast(targets)  # a number for each source
    sized = F.broadcast(spark.createDataFrame([(k, max(1, -(-n // rows_per_range))) for k, n in sizes.items()], "source string, ranges long"))

    @F.arrow_udf("slot long, release long, deadline long")
    def placed(names: pa.Array, halves: pa.Array) -> pa.Array:
        plan, seen, out = schedule(sent.value, slots_per_source), {}, []
        for at in zip(names.to_pylist(), halves.to_pylist(), strict=True):
            if at not in seen:
                seen[at] = plan.place(*at)
            out.append(seen[at])
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["slot", "release", "deadline"])

    # a source of n rows has ceil(n / rows_per_range) hash ranges; ranks go on from one range to the next
    ranged = lambda df: df.join(sized, "source").withColumn("range", F.pmod(F.shiftrightunsigned("key", 33), F.col("ranges")))
    per = ranged(rows.select("source", "key")).groupBy("source", "range").agg(F.count("*").alias("n"))
    before = per.select("source", "range", (F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "range").orderBy("key", "id")) - 1
    numbered = ranged(rows).withColumn("rank", inside).join(before, ["source", "range"]).withColumn("rank", F.col("rank") + F.col("before"))
    half = F.floor(F.col("rank") / half_rows)
    made = numbered.withColumn("half", half).withColumn("at", placed("source", "half"))
    shown = (F.col("at.slot"), F.col("half"), F.col("at.release"), F.col("at.deadline"), F.pmod(F.col("rank"), F.lit(half_rows)))
    return made.select("doc.*", *(x.cast("long").alias(c) for c, x in zip(names, shown, strict=True)))
