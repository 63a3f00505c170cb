"""Toxicity: a linear-chain conditional random field that tags toxic words.

Features of a token are its lower-cased word and the word's prefixes of 4 to 8 letters, as far as they are in the vocabulary: those that
mark toxic documents in a bounded sample of labelled rows (by likelihood ratio).  A token of a toxic document is labelled toxic when its
best feature is one that toxic documents have far more often; other tokens are labelled clean.  The field has two states, transition
weights and feature weights, learnt on all windows of ``WINDOW`` tokens of the sampled documents by its conditional likelihood (equal
windows, above all those without a feature, are one with a weight).  Scoring takes whole texts: between tokens that have a feature all
steps are alike, so forward and backward messages cross such gaps by a power of one 2 x 2 matrix, and the marginals are those of the whole
chain.  A document's score is a logistic function of its marginals' sum, their maximum and the text's length, fitted
on the sample; spans give the offending tokens' offsets.

Labels: learning folds only, one per id, contradicting and null ones left out; ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` other documents are
drawn by hash, and of several texts under one id the least.  The vocabulary has at most ``MAX_FEATURES`` entries, the most telling first: it
bounds the model, which every task holds, and on the given tables it is reached by prefixes that only say again what words say.  With no label of either class the score is the share of toxic labels (0 without labels).

Edge cases: a null text is empty; a text without words has a score too.  Null ids are scored.  Repeated rows are scored each.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, in_pieces, settle

MAX_TOXIC, MAX_CLEAN, MAX_FEATURES, WINDOW, ROUNDS = 1200, 1800, 4000, 32, 80
#: Cells that the arrays of one step may have: places of texts in ``marginals``, windows in ``_learn``.
CELLS, AT_ONCE = 1_000_000, 20_000
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 9)
MAX_KNOWN = 300_000


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    index: dict[str, int]
    weights: list[float]
    bias: float
    moves: list[list[float]]  # log weight from state to state
    final: list[float]  # intercept, and weights of what document() gives
    known: dict[str, float | None] = field(default_factory=dict)

    def emission(self, word: str) -> float | None:
        """Log weight of toxic against clean; None for a word without a feature."""
        ids = [self.index[f] for f in features(word) if f in self.index]
        return self.bias + sum(self.weights[i] for i in ids) if ids else None


def marginals(model: Model, rows: list[tuple[int, list[tuple[int, float]]]]):
    """For each (number of tokens, [(place, emission)]): the probabilities that the listed tokens are toxic, given the whole chain.

    Rows with about as many places are worked out together, so that one long text doesn't widen the arrays of all.
    """
    out: list = [None] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i][1]))
    at = 0
    while at < len(order):
        most = max(1, len(rows[order[at]][1]))
        some = order[at : at + max(1, CELLS // most)]
        for i, p in zip(some, _marginals(model, [rows[i] for i in some]), strict=True):
            out[i] = p
        at += len(some)
    return out


def _marginals(model: Model, rows: list[tuple[int, list[tuple[int, float]]]]):
    import numpy as np

    n = len(rows)
    most = max((len(h) for _, h in rows), default=0)
    if not most:
        return [np.zeros(0) for _ in rows]
    move = np.exp(np.array(model.moves))
    plain = np.array([1.0, np.exp(model.bias)])
    step = move * plain[None, :]  # a token without features, entered from the left
    values, vectors = np.linalg.eig(step)
    order = np.argsort(-np.abs(values))
    values, vectors = values[order].real, vectors[:, order].real
    inverse = np.linalg.inv(vectors)
    keep = vectors[:, :1] @ inverse[:1]
    fade, ratio = vectors[:, 1:] @ inverse[1:], values[1] / values[0]
    across = lambda gap: keep + np.power(ratio, gap)[:, None, None] * fade  # noqa: E731  step to the power gap, scaled
    place, emission, count = np.zeros((n, most), dtype=np.int64), np.zeros((n, most)), np.array([len(h) for _, h in rows])
    for i, (_, h) in enumerate(rows):
        if h:
            place[i, : len(h)], emission[i, : len(h)] = zip(*h, strict=True)
    length = np.array([x for x, _ in rows])
    heat = np.exp(emission)
    ahead = np.zeros((n, most, 2))
    state = np.ones((n, 2))
    for t in range(most):
        on = t < count
        gap = place[:, t] - (place[:, t - 1] + 1 if t else 0)
        if t:
            state_in = np.einsum("ni,nij->nj", ahead[:, t - 1], across(np.maximum(gap, 0)))
            state_in = state_in @ move
        else:  # the first token has no move into it
            first = np.where(gap[:, None] > 0, plain[None, :], 1.0)
            moved = np.einsum("ni,nij->nj", first, across(np.maximum(gap - 1, 0))) @ move
            state_in = np.where(gap[:, None] > 0, moved, 1.0)
        state = state_in * np.stack([np.ones(n), heat[:, t]], 1)
        state /= np.maximum(state.sum(1, keepdims=True), 1e-300)
        ahead[on, t] = state[on]
    behind = np.ones((n, 2))
    out = np.zeros((n, most))
    for t in range(most - 1, -1, -1):
        last = t == count - 1
        gap = np.where(last, length - place[:, t] - 1, (place[:, t + 1] if t + 1 < most else length) - place[:, t] - 1)
        if t + 1 < most:
            entered = (behind * np.stack([np.ones(n), heat[:, t + 1]], 1)) @ move.T
        else:
            entered = np.ones((n, 2))
        entered = np.where(last[:, None], 1.0, entered)
        new = np.einsum("nij,nj->ni", across(np.maximum(gap, 0)), entered)
        new /= new.sum(1, keepdims=True)
        behind = np.where((t < count)[:, None], new, behind)
        p = ahead[:, t] * behind
        out[:, t] = p[:, 1] / np.maximum(p.sum(1), 1e-300)
    return [out[i, : count[i]] for i in range(n)]


def document(n_tokens: int, p) -> list[float]:
    import numpy as np

    total, top = (float(p.sum()), float(p.max())) if len(p) else (0.0, 0.0)
    return [np.log1p(total), top, total / (1 + n_tokens / 300), np.log1p(n_tokens) / 5]


def tokens_of(text: str) -> list[str]:
    low = text.lower()
    if len(low) == len(text):
        return WORD.findall(low)
    return [w.lower() for w in WORD.findall(text)]  # letters that lower-casing lengthens: the words stay those of the text


def offsets_of(text: str) -> list[tuple[int, int]]:
    """Where the tokens are, in code points."""
    low = text.lower()
    return [m.span() for m in WORD.finditer(low if len(low) == len(text) else text)]


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    import numpy as np

    spark = docs.sparkSession
    one = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("other")).where("y = other").select("doc_id", "y").where(~held_out())
    pick = lambda y, n: one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, max_toxic).union(pick(0, max_clean))  # at most max_toxic + max_clean ids
    totals = dict(one.groupBy("y").count().collect())
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if not totals.get(0) or not totals.get(1):
        return Model({}, [], -8.0, [[0.0, 0.0], [0.0, 0.0]], [float(np.log((share + 1e-6) / (1 - share + 1e-6))), 0, 0, 0, 0])
    sample = settle(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    sizes = dict(sample.groupBy("y").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n0 or not n1:
        return Model({}, [], -8.0, [[0.0, 0.0], [0.0, 0.0]], [float(np.log((share + 1e-6) / (1 - share + 1e-6))), 0, 0, 0, 0])

    def listed(batches):
        import pandas as pd

        for b in batches:
            for y, text in zip(b["y"], b["text"], strict=True):
                yield pd.DataFrame({"f": list({f for w in set(tokens_of(text)) for f in features(w)}), "y": int(y)})

    counts = sample.select("y", "text").mapInPandas(listed, "f string, y int").groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a >= 5")
    rate = (F.col("a") / n1) / ((F.col("b") + 0.5) / n0)
    gain = F.col("a") * F.log(rate)
    found = counts.where(rate >= 2.5).orderBy(F.desc(gain), "f").limit(MAX_FEATURES).collect()
    index = {r["f"]: i for i, r in enumerate(found)}
    marks = {r["f"] for r in found if (r["a"] / n1) / ((r["b"] + 0.5) / n0) >= 5 and r["a"] * np.log((r["a"] / n1) / ((r["b"] + 0.5) / n0)) >= 12}

    def cut(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for doc_id, y, text in zip(b["doc_id"], b["y"], b["text"], strict=True):
                hits, at, ys = [], [], []
                toks = tokens_of(text)
                for i, w in enumerate(toks):
                    fs = features(w)
                    ids = [index[f] for f in fs if f in index]
                    if ids:
                        hits += ids
                        at += [i] * len(ids)
                        ys += [int(bool(y) and any(f in marks for f in fs))] * len(ids)
                rows.append((doc_id, int(y), len(toks), at, hits, ys))
            yield pd.DataFrame(rows, columns=["doc_id", "y", "n", "at", "f", "t"])

    rows = sorted(sample.mapInPandas(cut, "doc_id long, y int, n int, at array<int>, f array<int>, t array<int>").collect(), key=lambda r: r["doc_id"])
    model = _learn(rows, index)
    # the documents' own scores, each class weighted by its share of the labels
    y = [r["y"] for r in rows]
    x = [document(r["n"], p) for r, p in zip(rows, marginals(model, [(r["n"], _emissions(model, r)) for r in rows]), strict=True)]
    weight = np.where(np.array(y) == 1, share / n1, (1 - share) / n0) * len(y)
    model.final = [float(v) for v in _logistic(np.array(x), np.array(y, dtype=float), weight)]
    return model


def _emissions(model: Model, r) -> list[tuple[int, float]]:
    by: dict[int, float] = {}
    for i, f in zip(r["at"], r["f"], strict=True):
        by[i] = by.get(i, model.bias) + model.weights[f]
    return sorted(by.items())


def _windows(rows):
    """Different windows as (length, ((place, feature, label), ...)), and how many there are of each."""
    count: dict[tuple, int] = {}
    for r in rows:
        live: dict[int, list] = {}
        for i, f, t in zip(r["at"], r["f"], r["t"], strict=True):
            live.setdefault(i // WINDOW, []).append((i % WINDOW, f, t))
        for k in range(-(-r["n"] // WINDOW)):
            w = (min(WINDOW, r["n"] - k * WINDOW), tuple(live.get(k, ())))
            count[w] = count.get(w, 0) + 1
    # windows of about as many tokens with features together
    order = sorted(count, key=lambda w: (len(w[1]), w))
    return order, [count[w] for w in order]


def _learn(rows, index) -> Model:
    """Feature weights, bias and moves by conditional likelihood on all windows (Adam, full batch, ``AT_ONCE`` windows in memory)."""
    import numpy as np

    windows, many = _windows(rows)
    total = max(1, sum(many))
    parts = []
    for a in range(0, len(windows), AT_ONCE):
        some = windows[a : a + AT_ONCE]
        flat = np.array([i * WINDOW + p for i, (_, hits) in enumerate(some) for p, _, _ in hits], dtype=np.int64)
        fs = np.array([f for _, hits in some for _, f, _ in hits], dtype=np.int64)
        y = np.zeros(len(some) * WINDOW, dtype=np.int64)
        y[flat] = [t for _, hits in some for _, _, t in hits]
        y = y.reshape(-1, WINDOW)
        real = np.arange(WINDOW)[None, :] < np.array([n for n, _ in some])[:, None]
        weight = np.array(many[a : a + AT_ONCE], dtype=np.float64)
        follows = real[:, 1:] * weight[:, None]
        have = np.array([[((y[:, :-1] == p) & (y[:, 1:] == q)).ravel() @ follows.ravel() for q in (0, 1)] for p in (0, 1)])
        parts.append((flat, fs, y, real, weight, have, real[:, 1:]))
    w = np.concatenate([np.zeros(len(index)), [-3.0], np.zeros(4)])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, ROUNDS + 1):
        g = -1.0 * w
        for part in parts:
            g += _slope(w, len(index), *part)
        g /= total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.25 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(index, w[:-5].tolist(), float(w[-5]), w[-4:].reshape(2, 2).tolist(), [])


def _slope(w, size, flat, fs, y, real, weight, have, follows):
    """The likelihood's slope over some windows."""
    import numpy as np

    n = len(y)
    e = (w[-5] + np.bincount(flat, weights=w[fs], minlength=n * WINDOW)).reshape(n, WINDOW)
    move = np.exp(w[-4:].reshape(2, 2))
    heat = np.exp(np.clip(e, -30, 30))
    # messages as the odds' toxic share; states are (clean, toxic)
    ahead, behind = np.empty((WINDOW, n)), np.ones((WINDOW, n)) * 0.5
    ahead[0] = heat[:, 0] / (1 + heat[:, 0])
    for t in range(1, WINDOW):
        p = ahead[t - 1]
        clean, toxic = (1 - p) * move[0, 0] + p * move[1, 0], ((1 - p) * move[0, 1] + p * move[1, 1]) * heat[:, t]
        ahead[t] = toxic / (clean + toxic)
    for t in range(WINDOW - 2, -1, -1):
        q = behind[t + 1]
        clean, toxic = 1 - q, q * heat[:, t + 1]
        a, b = clean * move[0, 0] + toxic * move[0, 1], clean * move[1, 0] + toxic * move[1, 1]
        behind[t] = np.where(follows[:, t], b / (a + b), 0.5)
    p = ahead * behind
    p = (p / (p + (1 - ahead) * (1 - behind))).T
    slope = np.where(real, y - p, 0.0) * weight[:, None]
    # expected moves
    left, right = ahead[:-1].T, behind[1:].T
    hot = heat[:, 1:]
    pair = [[(1 - left) * move[0, 0] * (1 - right), (1 - left) * move[0, 1] * right * hot], [left * move[1, 0] * (1 - right), left * move[1, 1] * right * hot]]
    scale = follows * weight[:, None] / (pair[0][0] + pair[0][1] + pair[1][0] + pair[1][1])
    want = np.array([[(x * scale).sum() for x in row] for row in pair])
    return np.concatenate([np.bincount(fs, weights=slope.reshape(-1)[flat], minlength=size)[:size], [slope.sum()], (have - want).reshape(-1)])


def _logistic(x, y, weight, ridge: float = 1.0):
    import numpy as np

    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
        b = b + np.linalg.solve(hess, x.T @ (weight * (y - p)) - np.array([0, *[ridge] * (x.shape[1] - 1)]) * b)
    return b


def score_texts(model: Model, texts: list[str]) -> list[tuple[float, int, list, list[list[int]]]]:
    """For each text: score, tokens, marginals above one half, and those tokens' [start, end) in code points."""
    import numpy as np

    known, rows = model.known, []
    if len(known) > MAX_KNOWN:
        known.clear()
    for text in texts:
        toks = tokens_of(text)
        es = [known.get(w, 0) for w in toks]
        hits = []
        for i, e in enumerate(es):
            if e is None:
                continue
            if e == 0:
                w = toks[i]
                e = known.get(w, 0)
                if e == 0:
                    e = known[w] = model.emission(w)
                if e is None:
                    continue
            hits.append((i, e))
        rows.append((len(toks), hits))
    found = marginals(model, rows)
    out = []
    for text, (n, hits), p in zip(texts, rows, found, strict=True):
        z = model.final[0] + sum(a * b for a, b in zip(model.final[1:], document(n, p), strict=True))
        bad = [hits[i][0] for i in np.flatnonzero(p > 0.5).tolist()]
        spans = []
        if bad:
            where = offsets_of(text)
            spans = [list(where[i]) for i in bad]
        out.append((float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))), n, [float(v) for v in p[p > 0.5]], spans))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, n_tokens, spans`` of whole texts; spans: the offending tokens' offsets in code points, and marginals."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        for piece in in_pieces(batches):
            made = score_texts(model, piece.column("text").to_pylist())
            spans = pa.array([[{"start": a, "end": b, "p": v} for (a, b), v in zip(s, p, strict=True)] for _, _, p, s in made], kind)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.int32()), spans], names=["doc_id", "score", "n_tokens", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_tokens int, spans array<struct<start:int,end:int,p:double>>")
