"""Quality classifier: a sparse ensemble of rules.

Shallow randomised trees are grown on statistics of a bounded sample of labelled texts; every path from a root becomes a conjunctive rule;
a logistic regression with lasso penalty keeps few of them; the kept rules are compiled into one Spark column expression over the
statistics, which come from whole texts.

Labels: rows of the learning folds only (crc32 of the id as text, mod 5, is not 0), one per id; an id with contradicting labels is left
out, as is a null label.  Of several texts under one id, the least in byte order is learnt from.  ``MAX_TRAIN`` rows are drawn by the ids' hashes.  With no usable label the score is 0.5; with one class, its
share.

Edge cases: a null text is empty; an empty text has statistics of zero and a score like any other.  Null ids are scored.  Repeated rows
are scored each.  An empty table gives no rows.  Extra columns pass through ``keep``; they are no input of the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytewise import STATISTICS, statistics
from tessera.llm.common import held_out, in_pieces, text_bytes, whole_text

#: Rows that the rules are learnt from, at most.
MAX_TRAIN = 6000
TREES, DEPTH, MIN_LEAF = 60, 3, 12
KEEP_AT = 0.3


@dataclass(frozen=True)
class Rule:
    """All of ``conditions`` (statistic, at most, bound): value <= bound, or value > bound where ``at most`` is false."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self, of) -> Column:
        made = None
        for name, below, bound in self.conditions:
            c = of(name) <= bound if below else of(name) > bound
            made = c if made is None else made & c
        return F.when(made, F.lit(self.weight)).otherwise(0.0)


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]

    def column(self, of) -> Column:
        """The score, from columns ``of(name)`` of the statistics."""
        z = F.lit(self.intercept)
        for r in self.rules:
            z = z + r.column(of)
        return 1 / (1 + F.exp(-z))


def with_statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """``docs`` with a struct of the statistics of each whole text."""
    import numpy as np
    from pyspark.sql.functions import arrow_udf

    kind = "struct<" + ",".join(f"{k}:double" for k in STATISTICS) + ">"

    @arrow_udf(kind)
    def measured(texts: pa.Array) -> pa.Array:
        parts = [statistics(*text_bytes(p.column(0))) for p in in_pieces([pa.RecordBatch.from_arrays([texts], names=["text"])])]
        cols = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0)) for k in STATISTICS]
        return pa.StructArray.from_arrays(cols, names=STATISTICS)

    return docs.withColumn(out, measured(whole_text(text)))


def learning_rows(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``doc_id, y``: at most ``limit`` labelled ids of the learning folds, by hash."""
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other").select("doc_id", "y")
    return one.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    import numpy as np

    chosen = learning_rows(labels, "quality", max_train)  # at most max_train ids
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(whole_text()).alias("text"))
    rows = with_statistics(sample).select("doc_id", "y", "statistics.*").toPandas().sort_values("doc_id")
    return learn(rows[STATISTICS].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float)) if len(rows) else Model(0.0, ())


def learn(x, y, seed: int = 3) -> Model:
    import numpy as np

    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    prior = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Model(prior, ())
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    paths: dict[tuple, None] = {}
    for _ in range(TREES):
        rows = rng.choice(len(y), min(len(y), max(50, len(y) // 2)), replace=False)
        _grow(x, y, weight, rows, (), DEPTH, rng, paths)
    rules = list(paths)
    made = np.stack([_holds(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    # rules that hold for the same rows are one rule; the first, which is the shortest, stays
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i]), i))
    seen, unique = set(), []
    for i in order:
        mark = np.packbits(made[:, i] > 0).tobytes()
        if mark not in seen and 0 < made[:, i].sum() < len(y):
            seen.add(mark)
            unique.append(i)
    made, rules = made[:, unique], [rules[i] for i in unique]
    w, b = _lasso(made, y, 0.002)
    live = np.flatnonzero(np.abs(w) > 1e-3)
    w, b = _lasso(made[:, live], y, 0.0005) if len(live) else (w[live], b)  # less shrinkage on what was chosen
    return Model(round(float(b), 6), tuple(Rule(tuple((STATISTICS[j], below, float(t)) for j, below, t in rules[i]), round(float(v), 6)) for i, v in zip(live, w, strict=True) if abs(v) > 1e-3))


def _grow(x, y, weight, rows, path, depth, rng, paths) -> None:
    import numpy as np

    if depth == 0 or len(rows) < 2 * MIN_LEAF or y[rows].min() == y[rows].max():
        return
    best = (1e-9, None)
    w = weight[rows]
    total, ones = w.sum(), (w * y[rows]).sum()
    gini = lambda n, k: 2 * k * (n - k) / n
    for j in rng.choice(x.shape[1], 6, replace=False):
        v = x[rows, j]
        for t in np.unique(np.quantile(v, rng.random(8))):
            left = v <= t
            n = left.sum()
            if n < MIN_LEAF or len(rows) - n < MIN_LEAF:
                continue
            a, k = w[left].sum(), (w[left] * y[rows][left]).sum()
            gain = gini(total, ones) - gini(a, k) - gini(total - a, ones - k)
            if gain > best[0]:
                best = (gain, (int(j), float(f"{t:.6g}")))
    if best[1] is None:
        return
    j, t = best[1]
    for below in (True, False):
        step = tuple(sorted({*path, (j, below, t)}))
        paths.setdefault(step)
        _grow(x, y, weight, rows[(x[rows, j] <= t) == below], step, depth - 1, rng, paths)


def _holds(x, path):
    import numpy as np

    ok = np.ones(len(x), dtype=bool)
    for j, below, t in path:
        ok &= (x[:, j] <= t) == below
    return ok


def _lasso(x, y, penalty: float, rounds: int = 400):
    """Logistic regression, accelerated proximal steps; the intercept isn't shrunk."""
    import numpy as np

    n = len(y)
    ones = np.column_stack([x, np.ones(n)])
    step = 4 * n / max(np.linalg.norm(ones.T @ ones, 2), 1e-9)
    w = at = np.zeros(ones.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = at - step * (ones.T @ (1 / (1 + np.exp(-np.clip(ones @ at, -30, 30))) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, past = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        at, w = new + (past - 1) / t * (new - w), new
    return w[:-1], w[-1]


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``out``."""
    cols = [c for c in docs.columns if c != out]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("doc"), F.col(text).alias("text"))
    made = with_statistics(rows)
    return made.select(*(F.col(f"doc.`{c}`").alias(c) for c in cols), model.column(lambda k: F.col(f"statistics.{k}")).alias(out))


def keep(docs: DataFrame, labels: DataFrame, at: float = KEEP_AT) -> DataFrame:
    """The documents that score ``at`` or more, with the same columns."""
    out = "quality_score"
    while out.lower() in {c.lower() for c in docs.columns}:
        out = f"_{out}"
    return score(docs, fit(docs, labels), out=out).where(F.col(out) >= at).select(*(F.col(f"`{c}`") for c in docs.columns))
