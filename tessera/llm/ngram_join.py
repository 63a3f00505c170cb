"""N-gram Jaccard join by MinHash banding.

A text's set of word 5-grams (words: runs of bytes that aren't ASCII white space; a text of 1 to 4 words has one n-gram, all its words) is
sketched by MinHash; bands of the sketch are hashed, with as many bands and rows as the target recall at the threshold asks for, and
shuffled.  Within a band's bucket, sketches are compared (one byte a minimum): texts whose sketches agree far less than ``THRESHOLD``
asks for aren't candidates.  A bucket gives a spanning forest of its candidates, never its pairs, and a large one is dealt into blocks.
Only then do texts move, and only those of candidates, which a bitmap picks out before the shuffle: within a group of candidates all
pairs are compared on their full n-gram sets, in square blocks of bounded size.  A block counts each text's links and gives a spanning
forest of them; a group of one block needs no further rounds.

Equal texts are one class; only classes are compared, and classes' sizes count as links.  Links: Jaccard similarity of at least
``THRESHOLD``, on 64-bit n-gram hashes that come from tables of random numbers (two given n-grams clash with a chance of 2 to the -64).

Edge cases: null texts and texts without words link with nothing, not even each other.  A null id is kept, and is nobody's representative
while its class has an id.  Rows repeated with the same id and text are rows of one class.  An empty table gives no rows.  Extra
columns are ignored by ``links`` and pass through ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_text, frugal, settle, sieve, sieved, text_bytes, text_key, whole_text
from tessera.llm.graph import components

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.999, 5
#: A verified block holds about so many texts and n-grams a side; a block of a bucket so many sketches.
BLOCK_TEXTS, BLOCK_GRAMS, BUCKET = 2500, 1_200_000, 4000
#: Sketches of n minima agree in a share of mean J and standard deviation sqrt(J (1 - J) / n): so many deviations below the threshold.
SIGMAS = 4.5


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands with which a pair at the threshold shares one with probability ``recall``."""
    n = 1
    while 1 - (1 - threshold**rows) ** n < recall:
        n += 1
    return n


def sketches(docs: DataFrame, words: int = WORDS, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """``docs(doc_id, key, text)`` to ``doc_id, key, grams, bands, sketch``: the number of n-grams with repeats, one long a band, and the
    last byte of each minimum (no bands and no sketch without words)."""
    import numpy as np
    import pyarrow as pa

    bands = bands or bands_for(rows=rows)
    rng = np.random.default_rng(99)
    mult = rng.integers(1, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    plus = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def work(piece):
        from tessera.llm import bytewise as B

        data, bounds = text_bytes(piece.column("text"))
        _, _, hashes, first = B.words(data, bounds)
        grams, ends = B.shingles(hashes, first, words)
        n = len(bounds) - 1
        some = np.flatnonzero(np.diff(ends) > 0)
        small = (grams >> np.uint64(32)).astype(np.uint32)
        low = np.empty((bands * rows, len(some)), dtype=np.uint32)
        for k in range(bands * rows if len(some) else 0):
            low[k] = np.minimum.reduceat(small * mult[k] + plus[k], ends[:-1][some])
        keys = np.zeros((bands, len(some)), dtype=np.uint64)
        for b in range(bands):
            for r in range(rows):
                keys[b] = B.mixed(keys[b] * B.STEPS[r] + low[b * rows + r] + np.uint64(b + 1))
        sizes = np.zeros(n + 1, dtype=np.int64)
        sizes[some + 1] = bands
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(keys.T.reshape(-1).view(np.int64)))
        marks = (B.mixed(low.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).T
        sketch: list = [None] * n
        for i, m in zip(some.tolist(), marks, strict=True):
            sketch[i] = m.tobytes()
        return {"doc_id": piece.column("doc_id"), "key": piece.column("key"), "grams": np.diff(ends).astype(np.int32), "bands": lists, "sketch": pa.array(sketch, pa.binary())}

    return by_text(docs.select("doc_id", "key", "text"), work, "doc_id long, key binary, grams int, bands array<long>, sketch binary", 1_000_000)


def near_sketches(marks, threshold: float) -> list[tuple[int, int]]:
    """Edges (row, leader) that join all rows whose sketches agree enough for ``threshold``, and none that agree far less.

    Disagreement is a metric.  Leaders are picked until each row is within a third of the cut-off of one; a leader is joined to all
    rows within four thirds, so any two rows within the cut-off hang together by the leader of either.
    """
    import numpy as np

    n, width = marks.shape
    most = 1 - max(0.0, threshold - SIGMAS * (threshold * (1 - threshold) / width) ** 0.5)
    edges: list[tuple[int, int]] = []
    waiting = np.ones(n, dtype=bool)
    for leader in range(n):
        if not waiting[leader]:
            continue
        away = np.count_nonzero(marks != marks[leader], axis=1) / width
        waiting[away <= most / 3] = False
        edges += [(k, leader) for k in np.flatnonzero(away <= most * 4 / 3).tolist() if k != leader]
    return edges


def bucket_edges(shared: DataFrame, threshold: float) -> DataFrame:
    """``shared(band, n, key, sketch)``, the members of buckets of n > 1, to ``a, b``: the buckets' forests."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        from tessera.llm.embedding_dedup import spanning

        held: list[tuple[bytes, bytes]] = []
        now = None

        def forest_of():
            held.sort()
            edges = near_sketches(np.frombuffer(b"".join(s for _, s in held), dtype=np.uint8).reshape(len(held), -1), threshold) if len(held) > 1 else []
            edges = spanning(len(held), edges)
            return pa.RecordBatch.from_arrays([pa.array([held[a][0] for a, _ in edges], pa.binary()), pa.array([held[b][0] for _, b in edges], pa.binary())], names=["a", "b"])

        for batch in batches:
            for band, i, j, key, sketch in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "key", "sketch")), strict=True):
                if (band, i, j) != now:
                    if len(held) > 1:
                        yield forest_of()
                    now, held = (band, i, j), []
                held.append((key, sketch))
        if len(held) > 1:
            yield forest_of()

    side = F.ceil(F.col("n") / BUCKET).cast("int")
    part = F.pmod(F.xxhash64("key", F.lit("bucket")), side).cast("int")
    each = F.transform(F.sequence(F.lit(0), side - 1), lambda other: F.struct(F.least(part, other).alias("i"), F.greatest(part, other).alias("j")))
    dealt = shared.withColumn("at", F.explode(each)).select("band", "at.i", "at.j", "key", "sketch")
    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(frugal(run), "a binary, b binary")


def blocks(members: DataFrame) -> DataFrame:
    """``members(component, key, size, text, side, part)`` to ``component, i, j, left, alone, key, size, grams``: each text in its blocks.

    A component dealt into ``side`` parts has side * (side + 1) / 2 blocks; part p is in the blocks (i, j) with p = i or p = j.  alone: the
    component has one block.
    """
    import numpy as np
    import pyarrow as pa

    def work(piece):
        from tessera.llm import bytewise as B

        data, bounds = text_bytes(piece.column("text"))
        _, _, hashes, first = B.words(data, bounds)
        grams, ends = B.shingles(hashes, first, WORDS)
        cols: dict = {k: piece.column(k) for k in ("component", "key", "size", "side", "part")}
        return cols | {"grams": pa.array([np.unique(grams[a:b]).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())}

    with_grams = by_text(members.select("component", "key", "size", "side", "part", "text"), work, "component binary, key binary, size long, side int, part int, grams binary", 1_000_000)
    each = F.transform(F.sequence(F.lit(0), F.col("side") - 1), lambda other: F.struct(F.least("part", other).alias("i"), F.greatest("part", other).alias("j"), (F.col("part") <= other).alias("left")))
    return with_grams.withColumn("at", F.explode(each)).select("component", "at.i", "at.j", "at.left", (F.col("side") == 1).alias("alone"), "key", "size", "grams")


def compare(left: list, right: list | None, threshold: float):
    """Links between sorted arrays of n-grams: a boolean matrix.  ``right`` None: among ``left``."""
    import numpy as np

    every = left if right is None else left + right
    n, sizes = len(every), np.array([len(x) for x in every])
    flat = np.concatenate(every)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    g, row = flat[order], row[order]
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    counts = np.diff(np.append(at, len(g)))
    cut = 0 if right is None else len(left)
    tall, wide = (n, n) if right is None else (cut, n - cut)
    shared = np.zeros((tall, wide), dtype=np.float32)
    # n-grams of few texts by their pairs, those of many by products of 0/1 matrices
    for c in range(2, min(9, n + 1)):
        rows = row[at[counts == c][:, None] + np.arange(c)[None, :]]
        for a in range(c):
            for b in range(a + 1, c):
                x, y = rows[:, a], rows[:, b]  # ascending, by the stable sort
                if right is None:
                    np.add.at(shared, (x, y), 1)
                    np.add.at(shared, (y, x), 1)
                else:
                    ok = (x < cut) & (y >= cut)
                    np.add.at(shared, (x[ok], y[ok] - cut), 1)
    many = np.flatnonzero(counts >= 9)
    for k in range(0, len(many), 2048):
        part = many[k : k + 2048]
        dense = np.zeros((n, len(part)), dtype=np.float32)
        for c, p in enumerate(part.tolist()):
            dense[row[at[p] : at[p] + counts[p]], c] = 1
        shared += (dense if right is None else dense[:cut]) @ (dense if right is None else dense[cut:]).T
    a = sizes[:tall, None].astype(np.float64)
    b = (sizes if right is None else sizes[cut:])[None, :].astype(np.float64)
    links = shared >= threshold * (a + b - shared) - 1e-9
    if right is None:
        np.fill_diagonal(links, False)
    return links


def forest(links, right_apart: bool):
    """(i, root) for each vertex with a link; right vertices follow the left ones where the matrix has two sides."""
    import numpy as np

    if right_apart:
        a, b = links.shape
        label = np.arange(a + b)
        while True:
            new = label.copy()
            r = np.where(links, label[None, a:], a + b).min(1, initial=a + b)
            new[:a] = np.minimum(new[:a], r)
            c = np.where(links, new[:a, None], a + b).min(0, initial=a + b)
            new[a:] = np.minimum(new[a:], c)
            if (new == label).all():
                break
            label = new
    else:
        n = len(links)
        label = np.arange(n)
        while True:
            new = np.minimum(label, np.where(links, label[None, :], n).min(1, initial=n))
            new = new[new]
            if (new == label).all():
                break
            label = new
    return [(i, int(r)) for i, r in enumerate(label) if i != r]


def verify(dealt: DataFrame, threshold: float) -> DataFrame:
    """``key, other, links, alone``: rows with an ``other`` are edges of a spanning forest, the rest hold each text's links within a block.

    Where the component has one block, ``other`` is the least key that links reach (``alone``).
    """
    import numpy as np
    import pyarrow as pa

    def groups(batches) -> Iterator[tuple[tuple, list]]:
        now, held = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("component", "i", "j", "alone", "left", "key", "size", "grams")]
            for component, i, j, alone, left, key, size, grams in zip(*cols, strict=True):
                if (component, i, j, alone) != now:
                    if held:
                        yield now, sorted(held, key=lambda r: r[1])
                    now, held = (component, i, j, alone), []
                held.append((left, key, size, grams))
        if held:
            yield now, sorted(held, key=lambda r: r[1])

    out = pa.schema([("key", pa.binary()), ("other", pa.binary()), ("links", pa.int64()), ("alone", pa.bool_())])

    def run(batches):
        keys, others, counts, single = [], [], [], []
        for (_, i, j, alone), held in groups(batches):
            unpack = lambda rows: [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
            if i == j:
                links = compare(unpack(held), None, threshold) if len(held) > 1 else np.zeros((len(held), len(held)), dtype=bool)
                order, sizes = held, np.array([r[2] for r in held], dtype=np.int64)
                counted = links @ sizes
            else:
                left, right = [r for r in held if r[0]], [r for r in held if not r[0]]
                if not left or not right:
                    continue
                links = compare(unpack(left), unpack(right), threshold)
                order = left + right
                counted = np.concatenate([links @ np.array([r[2] for r in right], dtype=np.int64), links.T @ np.array([r[2] for r in left], dtype=np.int64)])
            for k in np.flatnonzero(counted).tolist():
                keys.append(order[k][1])
                others.append(None)
                counts.append(int(counted[k]))
            for a, b in forest(links, i != j):
                keys.append(order[a][1])
                others.append(order[b][1])
                counts.append(0)
            single += [alone] * (len(keys) - len(single))
            if len(keys) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, others, counts, single), out, strict=True)], schema=out)
                keys, others, counts, single = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, others, counts, single), out, strict=True)], schema=out)

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(frugal(run), "key binary, other binary, links long, alone boolean")


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links, component_id, kept`` for each row.

    class_id: least id with the same text; n_links: other rows linked directly, those with the same text included; component_id: least id
    that links reach; kept: the one row that stays of its component.
    """
    made, placed = classed(docs, threshold, recall)
    out = made.select("doc_id", "key").join(placed, "key", "left")
    class_id = F.coalesce("class_id", "doc_id")
    component = F.coalesce("component_id", class_id)
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull() & component.isNull()).alias("kept"))


def classed(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key`` of each row, and ``key, class_id, component_id, component, n_links`` of each text with words (component: a key, if linked)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), whole_text().alias("text"))
    made = settle(sketches(rows, bands=bands_for(threshold, recall)))
    # a row of each class brings bands and sketch; ids by themselves, so that copies meet as a few narrow rows
    classes = settle(made.where("grams > 0").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("grams").alias("grams")))
    banded = classes.select("key", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(banded.join(crowded, "band"))
    met = classes.select("key", "sketch").join(shared, "key").select("band", "n", "key", "sketch")
    candidates = components(bucket_edges(met, threshold))
    members = candidates.select(F.col("id").alias("key"), "component").join(classes.select("key", "class_id", "size", "grams"), "key")
    sides = members.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("side"))
    members = settle(members.join(sides, "component").withColumn("part", F.pmod(F.xxhash64("key", F.lit("part")), F.col("side")).cast("int")))
    # one row of each class brings the text: those that the bitmap lets pass are shuffled
    passed = sieved(rows.withColumn("hashed", F.xxhash64("key", "doc_id")), members.select(F.xxhash64("key", F.col("class_id").alias("doc_id")).alias("hashed"))).drop("hashed")
    wanted = members.select("key", "class_id", "size", "component", "side", "part")
    texts = passed.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")
    found = settle(verify(blocks(texts), threshold))
    counts = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    # components of one block are whole already; the others' forests are joined
    apart = components(found.where("other is not null and not alone").select(F.col("key").alias("a"), F.col("other").alias("b")))
    whole = found.where("other is not null and alone")
    groups = whole.select(F.col("key").alias("id"), F.col("other").alias("component")).union(whole.select(F.col("other").alias("id"), F.col("other").alias("component")).distinct()).union(apart.select("id", "component"))
    grouped = groups.join(members.select("key", "class_id"), F.col("id") == F.col("key")).select("key", "component", "class_id")
    least = grouped.groupBy("component").agg(F.min("class_id").alias("component_id"))
    placed = classes.select("key", "class_id", "size").join(counts, "key", "left").join(grouped.join(least, "component").select("key", "component", "component_id"), "key", "left")
    return made, placed.select("key", "class_id", "component_id", "component", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component, with all columns of ``docs``: the one with the least id, rows without an id last.

    Rows are told apart by id and text.  Of rows repeated with the same id and text one stays; rows without words are no one's copies and
    stay.
    """
    made, placed = classed(docs, threshold, RECALL)
    ids = made.select("doc_id", "key").join(placed.select("key", F.coalesce("component", "key").alias("head")), "key").groupBy("head", "key", "doc_id").agg(F.count("*").alias("n"))
    ids = settle(ids)
    ids = ids.join(ids.groupBy("head").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")), "head")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    # rows that go, and rows of which one stays; the others are told from them by a bitmap and not shuffled
    marked = settle(ids.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), kept.alias("_kept"), "n").where("not _kept or n > 1"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))
    told = sieve(rows.withColumn("hashed", F.xxhash64("key", "id")), marked.select(F.xxhash64("_key", "_id").alias("hashed")), "hashed", "maybe")
    found = told.where("maybe").join(marked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    one = found.where("_kept").groupBy("id", "key").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    stay = told.where("not maybe").select("doc").union(found.where("_kept is null").select("doc")).union(one.select("doc"))
    return stay.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
