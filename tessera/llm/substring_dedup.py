"""Substring dedup by content-defined chunking.

A gear hash rolls over each text's UTF-8 bytes (a table entry per byte, shifted left one bit a step, 32 bits, so 32 bytes of memory).
Anchors are content-defined: the least hash of every window of places that ``MIN_RUN`` bytes hold, so two texts that share ``MIN_RUN`` bytes
share an anchor in them, whatever stands around.  The 32 bytes at an anchor are its seed, known by a 64-bit digest.  A seed that occurs in
more than one document belongs to the document with the least id and is a repeat elsewhere; one that occurs twice in one document only is a
repeat from its second place on.  A repeat is extended to both sides for as long as its bytes equal those of the owner's text, and counts
from ``MIN_RUN`` bytes on.  Passages that touch are joined; ``cut`` removes them.  (``cuts`` gives the chunks of one text by fixed top bits.)

A seed is extended along its owner's first place of it only.  A passage is missed where each of its seeds also stands, in other
surroundings, in a document before the passage's or earlier in it.

What moves: seeds are settled once and counted with map-side combining; a bitmap of the repeated ones keeps the others out of the join.
A text whose bytes are those of an earlier document is one passage by its digest and has no seeds.  Seeds of one passage are at most
``MIN_RUN - SEED_BYTES + 1`` bytes apart, so the stretches that such seeds mark (with ``MIN_RUN`` bytes on either side) hold every
passage whole: only these stretches, and the texts of their owners, are shuffled.  Stretches meet their owner's text in a sorted stream,
and an owner of many is dealt to several tasks, as its stretches are.

Edge cases: a null text is empty; texts under ``MIN_RUN`` bytes have no seeds and stay.  Rows with a null id, or one that is no number,
count as one document before all others.  Rows with the same id and text are one document; rows with the same id and different texts
aren't compared with each other.  Texts of any length are read whole.  Cuts fall between code points.  An empty table gives no rows.
Extra columns pass through ``cut``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_text, frugal, settle, sieve, sieved, text_bytes, text_key, whole_text

MIN_CHUNK, MEAN_BITS, MAX_CHUNK, MIN_RUN = 16, 5, 256, 96
SEED, SEED_BYTES = 0x5EED, 32
NO_ID = -(2**63)
#: An owner's text is sent once for about so many stretches.
DEALT = 1000


def gear_table():
    import numpy as np

    return np.random.default_rng(SEED).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data, table):
    """The rolling hash at every byte: the sum of table[byte k back] << k over 32 bytes, in five doubling steps."""
    h = table[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            older = h.copy()
            h[k:] += older[:-k] << k
    return h


def cuts(data, table=None) -> list[int]:
    """Ends of the chunks of one text."""
    import numpy as np

    n = len(data)
    if not n:
        return []
    table = gear_table() if table is None else table
    # a cut must not part a code point: the next byte isn't a continuation
    begins = np.empty(n, dtype=bool)
    begins[:-1] = (data[1:] & 0xC0) != 0x80
    begins[-1] = True
    found = (np.flatnonzero((gear(data, table) >> (32 - MEAN_BITS) == 0) & begins) + 1).tolist()
    ends, start = [], 0
    for at in [*found, n]:
        while at - start > MAX_CHUNK:
            stop = start + MAX_CHUNK
            while stop > start + 1 and not begins[stop - 1]:
                stop -= 1
            ends.append(stop)
            start = stop
        if at - start >= MIN_CHUNK or (at == n and at > start):
            ends.append(at)
            start = at
    return ends


def anchors(data, table=None):
    """Places of one text's seeds: the first least hash of every ``MIN_RUN`` bytes."""
    import numpy as np

    if len(data) < MIN_RUN:
        return np.zeros(0, dtype=np.int64)
    h = gear(data, gear_table() if table is None else table)[SEED_BYTES - 1 :].astype(np.uint64)
    low, width, window = h << np.uint64(32) | np.arange(len(h), dtype=np.uint64), 1, MIN_RUN - SEED_BYTES + 1
    while width < window:
        step = min(width, window - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.append(True, at[1:] != at[:-1])]


def number(column: str = "doc_id"):
    return F.coalesce(F.expr(f"try_cast(`{column}` as long)"), F.lit(NO_ID))


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(number().alias("dk"), F.xxhash64(whole_text()).alias("th"), whole_text().alias("text")).where("text != ''")


def seeds(rows: DataFrame) -> DataFrame:
    """``rows(dk, th, text)`` to ``dk, th, start, again, h``: the seeds of every text; again: the digest has come before in the text."""
    import numpy as np
    import xxhash

    table = gear_table()

    def work(piece):
        data, bounds = text_bytes(piece.column("text"))
        raw = data.tobytes()
        dk, th = piece.column("dk").to_pylist(), piece.column("th").to_pylist()
        cols: dict[str, list] = {k: [] for k in ("dk", "th", "start", "again", "h")}
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            starts = anchors(data[a:b], table).tolist()
            digests = [xxhash.xxh3_64_intdigest(raw[a + s : a + s + SEED_BYTES]) - 2**63 for s in starts]
            seen: set[int] = set()
            cols["dk"] += [dk[i]] * len(starts)
            cols["th"] += [th[i]] * len(starts)
            cols["start"] += starts
            cols["again"] += [d in seen or seen.add(d) is not None for d in digests]
            cols["h"] += digests
        return {k: np.array(v, dtype=bool if k == "again" else np.int32 if k == "start" else np.int64) for k, v in cols.items()}

    return by_text(rows.select("dk", "th", "text"), work, "dk long, th long, start int, again boolean, h long", 1_000_000)


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated passages by document: ``dk, th, spans``; a span has start and size in bytes, and the owner of its first passage."""
    rows = identified(docs).withColumn("key", text_key())
    # whole copies: the first document with the same bytes owns them
    known = settle(rows.select("key", "dk", "th", F.octet_length("text").alias("size")).distinct())
    firsts = known.groupBy("key").agg(F.min("dk").alias("odk"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = settle(known.join(firsts, "key").where((F.col("dk") != F.col("odk")) & (F.col("size") >= MIN_RUN)).select("key", "dk", "th", "size", "odk"))
    # copies go by two bitmaps, without a shuffle of texts: the second brings back what the first takes by mistake, and a few copies
    # with it, whose seeds only say again what their digests said
    identity = lambda *c: F.xxhash64(*c).alias("hashed")
    gone = copies.select(identity("key", "dk"))
    mistaken = settle(sieved(known.withColumn("hashed", identity("key", "dk")), gone).join(copies.select("key", "dk"), ["key", "dk"], "left_anti").select(identity("key", "dk")))
    told = sieve(sieve(rows.withColumn("hashed", identity("key", "dk")), gone, "hashed", "copy"), mistaken, "hashed", "back")
    rows = told.where("not copy or back").select("dk", "th", "text")
    made = settle(seeds(rows))
    groups = settle(made.groupBy("h").agg(F.count("*").alias("n"), F.min("dk").alias("odk")).where("n > 1").drop("n"))
    hits = sieved(made.withColumn("hashed", F.col("h")), groups.select(F.col("h").alias("hashed"))).drop("hashed").join(groups, "h").where("again or dk != odk")
    # a repeated row brings each place twice
    by_doc = settle(hits.groupBy("dk", "th").agg(F.array_sort(F.collect_set(F.struct("start", "odk"))).alias("hits")))
    plain = identified(docs)
    texts = sieved(plain.withColumn("hashed", identity("dk", "th")), by_doc.select(identity("dk", "th"))).groupBy("dk", "th").agg(F.first("text").alias("text"))
    near = settle(stretches(by_doc.join(texts, ["dk", "th"])))
    # an owner of more than DEALT stretches is dealt to several tasks; such owners are few, and joined by Spark's own choice
    counts = near.groupBy("odk").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    wanted, hot = near.select(identity("odk")).distinct(), settle(counts.where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    owners = sieved(plain.withColumn("hashed", identity("dk")), settle(wanted)).select(F.col("dk").alias("odk"), "dk", "th", "text").join(hot, "odk", "left")
    none = lambda kind: F.lit(None).cast(kind)
    sent = owners.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("odk", "part", F.lit(0).alias("kind"), "dk", "th", F.col("text").cast("binary").alias("text"), none("int").alias("base"), none("array<int>").alias("places"))
    asked = near.join(hot, "odk", "left").select("odk", F.pmod(F.xxhash64("dk", "th", "base"), parts).cast("int").alias("part"), F.lit(1).alias("kind"), "dk", "th", "text", "base", "places")
    found = extended(sent.unionByName(asked))
    whole = copies.select("dk", "th", F.lit(0).alias("start"), "size", F.col("odk").alias("owner"))
    return joined(found.unionByName(whole).groupBy("dk", "th").agg(F.collect_list(F.struct("start", "size", "owner")).alias("hits")))


def stretches(both: DataFrame) -> DataFrame:
    """``both(dk, th, hits, text)`` to ``dk, th, odk, base, places, text``: for each owner of a seed in a stretch, the stretch's bytes from ``base`` on."""
    import numpy as np
    import pyarrow as pa

    out = pa.schema([("dk", pa.int64()), ("th", pa.int64()), ("odk", pa.int64()), ("base", pa.int32()), ("places", pa.list_(pa.int32())), ("text", pa.binary())])

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            hits = batch.column("hits")
            places_of, owners_of, ends = hits.values.field("start").to_numpy(), hits.values.field("odk").to_numpy(), hits.offsets.to_numpy()
            for i, (dk, th) in enumerate(zip(batch.column("dk").to_pylist(), batch.column("th").to_pylist(), strict=True)):
                raw = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                starts, odks = places_of[ends[i] : ends[i + 1]], owners_of[ends[i] : ends[i + 1]]
                heads = np.flatnonzero(np.append(True, np.diff(starts) > MIN_RUN - SEED_BYTES + 1))
                for at, end in zip(heads.tolist(), [*heads[1:].tolist(), len(starts)], strict=True):
                    base = max(0, int(starts[at]) - MIN_RUN)
                    piece = raw[base : int(starts[end - 1]) + SEED_BYTES + MIN_RUN]
                    for odk in np.unique(odks[at:end]).tolist():
                        rows.append({"dk": dk, "th": th, "odk": odk, "base": base, "places": starts[at:end][odks[at:end] == odk].tolist(), "text": piece})
                        size += len(piece)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return both.select("dk", "th", "hits", "text").mapInArrow(frugal(run), "dk long, th long, odk long, base int, places array<int>, text binary")


def alike(a, b) -> int:
    """How many bytes are equal from the start on."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        other = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        k = int(other.argmax())
        if other[k]:
            return at + k
        at, step = at + len(other), min(2 * step, 65_536)
    return n


def starts_in(text: bytes, owner: bytes, places: list[int], base: int | None) -> list[tuple[int, int]]:
    """Each place of a seed with the seed's first place in the owner; ``base``: where the text begins in the owner, if that is the text itself."""
    found = [(p, owner.find(text[p : p + SEED_BYTES])) for p in places]
    return [(p, at) for p, at in found if at >= 0 and (base is None or at < p + base)]


def grown(text, owner, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Passages of at least ``MIN_RUN`` bytes, as (start, end), that the places (start, start in the owner) grow to."""
    along: dict[int, int] = {}
    out, head, tail = [], 0, 0
    for s, o in sorted(places):
        # on the same line as a passage, or so deep in one that what leads out of it has an anchor nearer to its end
        if s < along.get(s - o, -1) or (head + MIN_RUN <= s and s + SEED_BYTES + MIN_RUN <= tail):
            continue
        left, right = alike(text[:s][::-1], owner[:o][::-1]), alike(text[s:], owner[o:])
        along[s - o] = s + right
        a, b = s - left, s + right
        if b - a >= MIN_RUN and b > tail:
            head, tail = a, b
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b - a >= MIN_RUN:
            out.append((a, b))
    return out


def extended(both: DataFrame) -> DataFrame:
    """Owners' texts (kind 0) and stretches (kind 1), told apart by ``odk, part``, to ``dk, th, start, size, owner``: the passages shared."""
    import numpy as np
    import pyarrow as pa

    out = pa.schema([("dk", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("owner", pa.int64())])

    def run(batches):
        now, owners = None, {}
        for batch in batches:
            rows = []
            for at, kind, dk, th, text, base, places in zip(zip(batch.column("odk").to_pylist(), batch.column("part").to_pylist(), strict=True), *(batch.column(c).to_pylist() for c in ("kind", "dk", "th", "text", "base", "places")), strict=True):
                if at != now:
                    now, owners = at, {}
                if kind == 0:
                    owners[th] = text  # another text of the same id has another hash
                    continue
                piece = np.frombuffer(text, dtype=np.uint8)
                for oth, raw in owners.items():
                    if dk == at[0] and th != oth:
                        continue
                    spans = grown(piece, np.frombuffer(raw, dtype=np.uint8), starts_in(text, raw, [p - base for p in places], base if dk == at[0] else None))
                    rows += [{"dk": dk, "th": th, "start": a + base, "size": b - a, "owner": at[0]} for a, b in spans]
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "odk", "part").sortWithinPartitions("odk", "part", "kind").mapInArrow(frugal(run), "dk long, th long, start int, size int, owner long")


def joined(hits: DataFrame) -> DataFrame:
    """Passages that overlap or touch as one span."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("owner", pa.int64())]))

    def run(batches):
        for batch in batches:
            lists = []
            for row in batch.column("hits").to_pylist():
                spans: list[dict] = []
                for x in sorted(row, key=lambda x: (x["start"], -x["size"], x["owner"])):
                    if spans and x["start"] <= spans[-1]["start"] + spans[-1]["size"]:
                        spans[-1]["size"] = max(spans[-1]["size"], x["start"] + x["size"] - spans[-1]["start"])
                    else:
                        spans.append(x)
                lists.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("th"), pa.array(lists, kind)], names=["dk", "th", "spans"])

    return hits.mapInArrow(frugal(run), "dk long, th long, spans array<struct<start:int,size:int,owner:long>>")


def passages(docs: DataFrame) -> DataFrame:
    """A row for each repeated passage: ``doc_id, start, size, owner_id``; documents without one don't appear."""
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    flat = repeats(docs).select("dk", "th", F.explode("spans").alias("x")).select("dk", "th", "x.*")
    return flat.select(null("dk").alias("doc_id"), "start", "size", null("owner").alias("owner_id"), F.col("th").alias("text_hash"))


def cut(docs: DataFrame) -> DataFrame:
    """``docs`` without its repeated passages, with the same columns; ``n_chars``, if there is one, follows a text that was cut."""
    spans = settle(repeats(docs))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), number().alias("dk"), F.xxhash64(whole_text()).alias("th"))
    # texts without a passage aren't shuffled
    told = sieve(rows.withColumn("hashed", F.xxhash64("dk", "th")), spans.select(F.xxhash64("dk", "th").alias("hashed")), "hashed", "maybe")
    found = told.where("maybe").select("doc", "dk", "th").join(spans, ["dk", "th"], "left").select("doc", "spans")
    found = found.unionByName(told.where("not maybe").select("doc", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    raw = F.col("doc.text").cast("binary")
    edge = lambda i: F.when(i < 0, F.lit(0)).otherwise(F.get("spans", i)["start"] + F.get("spans", i)["size"])
    stop = lambda i: F.coalesce(F.get("spans", i)["start"], F.length(raw))
    piece = lambda i: F.decode(F.substring(raw, edge(i - 1) + 1, stop(i) - edge(i - 1)), "UTF-8")
    kept = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size("spans")), piece), ""))
    found = found.withColumn("kept", kept)
    special = {"text": F.col("kept"), "n_chars": F.when(F.col("spans").isNull(), F.col("doc.n_chars") if "n_chars" in docs.columns else None).otherwise(F.length("kept").cast("long"))}
    return found.select(*(special[c].alias(c) if c in special else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
