"""Embedding near-dedup on a robust-pruned flat graph.

Vectors are scaled to length 1 in double precision; equal ones are one class.  Centres are drawn from a bounded sample; every class goes to
the shard of its nearest centre.  A shard too large for a task is dealt into parts, and each pair of parts is a task.  A task builds a flat
graph: from every vector's nearest neighbours, pruned so that an edge is dropped when a kept neighbour is much nearer to its end (robust
pruning), with reverse edges.  The adjacency lists of all tasks are united.  Then each task searches every one of its vectors: greedily from
the task's medoid with a beam, and once it is within range, by expanding all neighbours in range until none is new.  Found pairs are
verified by cosine in double precision.

Pairs whose shards differ are all compared (``across``): in 64 dimensions a neighbour at cosine 0.9 may lie in nearly any shard, so bounds
from the centres leave nothing out.  Classes are dealt into blocks and each pair of blocks is a matrix product: its arithmetic is the square
of the number of vectors, and each vector is sent once for every ``BLOCK`` vectors.

A pair is counted in one task only, its shard's or its blocks', so links are counted without listing pairs; tasks give each vector's count
and a spanning forest.  ``audit`` measures recall against brute force.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths
don't link.  A null id is kept.  Rows repeated with the same id and vector link as any equal vectors do.  An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle
from tessera.llm.graph import components
from tessera.llm.ngram_join import forest

THRESHOLD = 0.9
#: Vectors that centres are fitted on, at most, and vectors a centre and a task shall have.
SAMPLE, SHARD, PART = 8192, 800, 2000
#: Vectors in a block of the comparison across shards.
BLOCK = 16_000
DEGREE, BEAM, ALPHA = 24, 32, 1.2


def scaled(vectors):
    """Rows scaled to length 1, and which rows can link."""
    import numpy as np

    v = np.asarray(vectors, dtype=np.float64)
    with np.errstate(all="ignore"):
        top = np.abs(v).max(1, keepdims=True, initial=0)
        v = v / top  # else squares of very large or small components leave the range
        v = v / np.sqrt((v * v).sum(1, keepdims=True))
    good = np.isfinite(v).all(1)
    return v, good


def build(v, degree: int = DEGREE, alpha: float = ALPHA):
    """Adjacency (-1: none) of a robust-pruned flat graph over unit rows, and the medoid."""
    import numpy as np

    n = len(v)
    medoid = int(np.argmax(v @ v.mean(0)))
    if n == 1:
        return np.full((1, 1), -1, dtype=np.int32), medoid
    pool = min(n - 1, 2 * degree)
    near = np.empty((n, pool), dtype=np.int32)
    rng = np.random.default_rng(5)
    far = rng.integers(0, n, (n, 4)).astype(np.int32)  # a few long edges among the candidates keep the graph in one piece
    for a in range(0, n, 512):
        s = v[a : a + 512] @ v.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
        near[a : a + 512] = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
    pool_ids = np.concatenate([near, far], 1)
    out = np.full((n, 2 * degree), -1, dtype=np.int32)
    for a in range(0, n, 256):
        ids = pool_ids[a : a + 256]
        s = np.einsum("ad,akd->ak", v[a : a + 256], v[ids])
        s[ids == np.arange(a, a + len(ids))[:, None]] = -9
        order = np.argsort(-s, axis=1, kind="stable")
        ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
        between = np.einsum("akd,ald->akl", v[ids], v[ids])
        alive = s > -5
        kept = np.zeros(len(ids), dtype=np.int64)
        for k in range(ids.shape[1]):
            take = alive[:, k] & (kept < degree)
            rows = np.flatnonzero(take)
            out[a + rows, kept[rows]] = ids[rows, k]
            kept[rows] += 1
            # squared distances: alpha * d(kept, other) <= d(own, other) drops the other
            covered = alpha * (1 - between[rows, k]) <= (1 - s[rows])
            covered[:, : k + 1] = False
            alive[rows] &= ~covered
            alive[rows, k] = False
    # reverse edges, as far as there is room
    src, slot = np.nonzero(out >= 0)
    dst = out[src, slot]
    fill = (out >= 0).sum(1)
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        if fill[b] < out.shape[1] and a not in out[b, : fill[b]]:
            out[b, fill[b]] = a
            fill[b] += 1
    return out, medoid


def search(v, adjacency, medoid: int, queries, threshold: float, beam: int = BEAM):
    """Rows in range of each query row: a boolean matrix, by greedy search from the medoid and then range expansion."""
    import numpy as np

    n, q = len(v), len(queries)
    n_beam = min(beam, n)
    seen = np.zeros((q, n), dtype=bool)
    seen[:, medoid] = True
    hit = np.zeros((q, n), dtype=bool)
    w = v[queries]
    sims = np.full((q, n_beam), -9.0)
    ids = np.full((q, n_beam), -1, dtype=np.int64)
    open_ = np.zeros((q, n_beam), dtype=bool)
    sims[:, 0], ids[:, 0], open_[:, 0] = w @ v[medoid], medoid, True
    hit[:, medoid] = sims[:, 0] >= threshold
    live = np.arange(q)
    while len(live):
        best = np.where(open_[live], sims[live], -9).argmax(1)
        ok = open_[live, best]
        live, best = live[ok], best[ok]
        if not len(live):
            break
        open_[live, best] = False
        around = adjacency[ids[live, best]]
        fresh = (around >= 0) & ~seen[live[:, None], np.maximum(around, 0)]
        s = np.where(fresh, np.einsum("qd,qkd->qk", w[live], v[np.maximum(around, 0)]), -9.0)
        r, c = np.nonzero(fresh)
        seen[live[r], around[r, c]] = True
        inside = s[r, c] >= threshold
        hit[live[r[inside]], around[r[inside], c[inside]]] = True
        all_s = np.concatenate([sims[live], s], 1)
        all_i = np.concatenate([ids[live], around], 1)
        all_o = np.concatenate([open_[live], fresh], 1)
        top = np.argpartition(-all_s, n_beam - 1, axis=1)[:, :n_beam]
        sims[live], ids[live], open_[live] = (np.take_along_axis(x, top, 1) for x in (all_s, all_i, all_o))
    hit[np.arange(q), queries] = True  # a vector is in its own range: expansion goes on from its own edges as well
    done = np.zeros((q, n), dtype=bool)
    while True:
        a, b = np.nonzero(hit & ~done)
        if not len(a):
            break
        done[a, b] = True
        for k in range(0, len(a), 20_000):
            x = np.repeat(a[k : k + 20_000], adjacency.shape[1])
            y = adjacency[b[k : k + 20_000]].reshape(-1)
            ok = y >= 0
            x, y = x[ok], y[ok]
            new = ~seen[x, y]
            x, y = x[new], y[new]
            pairs = np.unique(x * n + y)
            x, y = pairs // n, pairs % n
            near = np.einsum("pd,pd->p", w[x], v[y]) >= threshold
            seen[x, y] = True
            hit[x[near], y[near]] = True
    hit[np.arange(q), queries] = False
    return hit


def centres_of(sample, count: int, seed: int = 11):
    """Spherical k-means on unit rows."""
    import numpy as np

    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(8):
        near = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, key, dim, unit``: unit rows as bytes of doubles; key and unit are null where a vector can't link."""
    import numpy as np
    import pyarrow as pa
    import xxhash


    def run(batches):
        for b in batches:
            keys, dims, units = [], [], []
            for row in b.column("embedding"):
                row = row.as_py()
                if not row or any(x is None for x in row):
                    keys.append(None), dims.append(None), units.append(None)
                    continue
                raw = np.array([row], dtype=np.float64)
                unit, good = scaled(raw)
                keys.append(xxhash.xxh3_128_digest(raw.tobytes()) if good[0] else None)
                dims.append(len(row) if good[0] else None)
                units.append(unit[0].tobytes() if good[0] else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "key", "dim", "unit"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, key binary, dim int, unit binary")


def assign(classes: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``key, dim, size, unit, shard``: each class in its nearest centre's shard."""
    import numpy as np
    import pyarrow as pa

    centres = {}
    for dim, n in classes.groupBy("dim").count().collect():  # a row for each length of vector
        most = max(256, min(sample, 64_000_000 // (8 * dim)))
        rows = classes.where(F.col("dim") == dim).orderBy("key").limit(most).select("unit").collect()
        centres[dim] = centres_of(np.stack([np.frombuffer(r[0]) for r in rows]), max(1, min(len(rows) // 4, -(-n // shard))))
    sent = classes.sparkSession.sparkContext.broadcast(centres)  # at most sample / 4 centres a length

    def run(batches):
        for b in batches:
            near = [int((sent.value[dim] @ np.frombuffer(unit)).argmax()) for dim, unit in zip(b.column("dim").to_pylist(), b.column("unit").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "dim", "size", "unit")), pa.array(near, pa.int32())], names=["key", "dim", "size", "unit", "shard"])

    return classes.select("key", "dim", "size", "unit").mapInArrow(run, "key binary, dim int, size long, unit binary, shard int")


def deal(placed: DataFrame, part: int = PART) -> DataFrame:
    """The tasks' rows: ``dim, shard, i, j, part`` and the other columns; a shard of more than ``part`` classes has several parts."""
    parts = placed.groupBy("dim", "shard").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    row = placed.join(parts, ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("key", F.lit("part")), F.col("parts")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least("part", other).alias("i"), F.greatest("part", other).alias("j")))
    return row.withColumn("at", F.explode(each)).select("dim", "shard", "at.i", "at.j", "part", *(c for c in placed.columns if c not in ("dim", "shard")))


TASK = ("dim", "shard", "i", "j")


def tasks(batches, columns):
    now, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in (*TASK, *columns)), strict=True):
            if row[:4] != now:
                if held:
                    yield now, held
                now, held = row[:4], []
            held.append(row[4:])
    if held:
        yield now, held


def grouped(dealt: DataFrame) -> DataFrame:
    return dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), *TASK).sortWithinPartitions(*TASK, "key")


def graphs(dealt: DataFrame) -> DataFrame:
    """``key, around``: adjacency lists of all tasks, united."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for _, held in tasks(batches, ("key", "unit")):
            keys = np.array([h[0] for h in held], dtype=object)
            adjacency, _ = build(np.stack([np.frombuffer(h[1]) for h in held]))
            around = [keys[a[a >= 0]].tolist() for a in adjacency]
            yield pa.RecordBatch.from_arrays([pa.array(keys.tolist(), pa.binary()), pa.array(around, pa.list_(pa.binary()))], names=["key", "around"])

    made = grouped(dealt.select(*TASK, "key", "unit")).mapInArrow(run, "key binary, around array<binary>")
    return made.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("around"))


def found(dealt: DataFrame, united: DataFrame, threshold: float) -> DataFrame:
    """``key, other, links``, as in the n-gram join: forest edges, and counts of linked vectors."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for (_, _, i, j), held in tasks(batches, ("part", "key", "size", "unit", "around")):
            v = np.stack([np.frombuffer(h[3]) for h in held])
            keys, sizes = [h[1] for h in held], np.array([h[2] for h in held], dtype=np.int64)
            index = {k: n for n, k in enumerate(keys)}
            lists = [[index[x] for x in h[4] or () if x in index] for h in held]
            adjacency = np.full((len(held), max(1, max(map(len, lists)))), -1, dtype=np.int32)
            for n, x in enumerate(lists):
                adjacency[n, : len(x)] = x
            medoid = int(np.argmax(v @ v.mean(0)))
            part = np.array([h[0] for h in held])
            counts = np.zeros(len(held), dtype=np.int64)
            edges: list[tuple[int, int]] = []
            label = np.arange(len(held))
            for a in range(0, len(held), 256):
                queries = np.arange(a, min(a + 256, len(held)))
                hit = search(v, adjacency, medoid, queries, threshold)
                x, y = np.nonzero(hit)
                x = queries[x]
                edges += list(zip(x.tolist(), y.tolist(), strict=True)) if len(x) < 2000 else [(p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True) if label[q] != label[p] and not label.__setitem__(q, label[p])]
                if not len(x):
                    continue
                ok = (part[x] == i) & (part[y] == j) | (part[x] == j) & (part[y] == i)
                np.add.at(counts, x[ok], sizes[y[ok]])
            yield counted(keys, counts, spanning(len(held), edges))

    rows = dealt.join(united, "key", "left")
    return grouped(rows.select(*TASK, "part", "key", "size", "unit", "around")).mapInArrow(run, "key binary, other binary, links long")


def across(placed: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``key, other, links`` as in ``found``, of the pairs whose shards differ: all of them, by products of blocks."""
    import numpy as np

    def run(batches):
        for (_, _, i, j), held in tasks(batches, ("part", "key", "size", "unit", "home")):
            keys, sizes = [h[1] for h in held], np.array([h[2] for h in held], dtype=np.int64)
            v = np.stack([np.frombuffer(h[3]) for h in held])
            part, home = np.array([h[0] for h in held]), np.array([h[4] for h in held])
            left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
            w, there = v[right], home[right]
            counts = np.zeros(len(held), dtype=np.int64)
            edges: list[tuple[int, int]] = []
            for a in range(0, len(left), 256):
                x = left[a : a + 256]
                hit = (v[x] @ w.T >= threshold) & (home[x][:, None] != there[None, :])
                rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                if not len(rows):
                    continue
                hit, p, q = hit[np.ix_(rows, cols)], x[rows], right[cols]
                counts[p] += hit @ sizes[q]
                if i != j:
                    counts[q] += hit.T @ sizes[p]
                ends = np.concatenate([p, q]).tolist()
                edges += [(ends[m], ends[r]) for m, r in forest(hit, True)]
                if len(edges) > 200_000:
                    edges = spanning(len(held), edges)
            yield counted(keys, counts, spanning(len(held), edges))

    blocks = deal(placed.withColumn("home", F.col("shard")).withColumn("shard", F.lit(-1)), block)
    return grouped(blocks.select(*TASK, "part", "key", "size", "unit", "home")).mapInArrow(run, "key binary, other binary, links long")


def counted(keys: list, counts, edges: list[tuple[int, int]]):
    """A task's rows: counts of its vectors that have links, then its forest's edges."""
    import numpy as np
    import pyarrow as pa

    some = np.flatnonzero(counts).tolist()
    return pa.RecordBatch.from_arrays([
        pa.array([keys[n] for n in some] + [keys[p] for p, _ in edges], pa.binary()), pa.array([None] * len(some) + [keys[q] for _, q in edges], pa.binary()), pa.array([int(counts[n]) for n in some] + [0] * len(edges), pa.int64()),
    ], names=["key", "other", "links"])


def spanning(n: int, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in edges:
        p, q = top(a), top(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((a, b))
    return kept


def links(embeddings: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, part: int = PART) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    made = settle(vectors(embeddings))
    classes = settle(made.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("size"), F.first("dim").alias("dim"), F.first("unit").alias("unit")))
    placed = settle(assign(classes, shard))
    dealt = settle(deal(placed, part))
    made_links = settle(found(dealt, graphs(dealt), threshold).union(across(placed, threshold)))
    counts = made_links.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(made_links.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    joined = groups.join(classes.select("key", "class_id"), F.col("id") == F.col("key")).select("key", "component", "class_id")
    least = joined.groupBy("component").agg(F.min("class_id").alias("component_id"))
    placed = classes.select("key", "class_id", "size").join(counts, "key", "left").join(joined.join(least, "component").select("key", "component_id"), "key", "left")
    placed = placed.select("key", F.coalesce("component_id", "class_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = made.select("vec_id", "key").join(placed, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def audit(embeddings: DataFrame, result: DataFrame, queries: int = 200, threshold: float = THRESHOLD) -> float:
    """Share of the links of at most ``queries`` vectors (by hash of the id) that the result counts, against brute force over all rows."""
    import numpy as np

    made = vectors(embeddings).where("key is not null")
    picked = made.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).collect()
    q = {r["vec_id"]: np.frombuffer(r["unit"]) for r in picked}
    want = {k: -1 for k in q}

    def run(batches):
        import pandas as pd

        for b in batches:
            v = [np.frombuffer(u) for u in b["unit"]]
            yield pd.DataFrame([(k, sum(int(len(u) == len(x) and float(u @ x) >= threshold) for u in v)) for k, x in q.items()], columns=["vec_id", "n"])

    for k, n in made.select("unit").mapInPandas(run, "vec_id long, n long").groupBy("vec_id").sum("n").collect():
        want[k] += n
    have = {r["vec_id"]: r["n_links"] for r in result.where(F.col("vec_id").isin(list(q))).collect()}
    total = sum(want.values())
    return 1.0 if not total else sum(min(want[k], have.get(k, 0)) for k in q) / total
