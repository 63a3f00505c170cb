"""Document fingerprints: a Merkle tree over sections, paragraphs and word runs.

A text is cut into paragraphs (lines, each with the line end and the blank lines after it), sections (paragraphs up to one with blank lines
after it) and, within a paragraph, leaves: runs of words that end where a word's hash says so, so an edit moves no cut but those beside
it.  White space belongs to leaves, so a text is its leaves, joined.  A leaf's digest is that of its bytes, a node's that of its
children's digests, and the root is the SHA-256 of the sections' digests: equal texts have equal roots, and texts with equal roots are
equal unless two 64-bit digests clash.  The fingerprint spells the tree out: ``root:section,section,...`` with a section as
``digest(paragraph.paragraph...)`` and a paragraph as its leaves' digests joined by ``-``.

``likeness`` compares subtrees from the top and counts the leaves they share; ``differing`` gives the leaves of either text that the other
lacks (or, where leaves only changed places, those places), so every edit is located: white space, moves and deletions as well.

Edge cases: a null or empty text has one tree without leaves (two such: likeness 1; beside any other text: 0); a text of white space has
one leaf.  Texts of any length are taken whole.  Rows with a null id sort first.  Repeated rows are kept: the next document of a row is the
next row in (id, text digest) order.  With one document only, its next is itself.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle

Tree = tuple[str, list[tuple[str, list[list[str]]]]]
#: Words end a leaf with one chance in so many.
MEAN_LEAF = 4
#: Hashes of so many words, and trees of paragraphs with so many characters, are kept while a partition is read.
MOST_WORDS, MOST_CHARS = 200_000, 4_000_000
#: Sort keys that are drawn for each range.
DRAWN = 40
PARAGRAPH = re.compile(r"\s*\S[^\n]*(?:\n(?:[^\S\n]*\n)*(?:[^\S\n]+\Z)?)?")
TOKEN = re.compile(r"\s*\S+")
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_leaves long, first_edited_leaf long"


class Memory:
    """Which words end a leaf, and paragraphs' digests, as far as they were worked out."""

    def __init__(self):
        self.ends: dict[str, bool] = {}
        self.paragraphs: dict[str, tuple[str, list[str], bool]] = {}
        self.chars = 0

    def paragraph(self, text: str) -> tuple[str, list[str], bool]:
        """Digest, leaves' digests, and whether the section ends with it."""
        if (made := self.paragraphs.get(text)) is None:
            if self.chars > MOST_CHARS:
                self.paragraphs.clear()
                self.chars = 0
            if len(self.ends) > MOST_WORDS:
                self.ends.clear()
            leaves = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() for x in leaves_of(text, self.ends)]
            made = self.paragraphs[text] = (_node("p", leaves), leaves, text.count("\n", len(text.rstrip())) > 1)
            self.chars += len(text)
        return made


def paragraphs_of(text: str) -> list[str]:
    return PARAGRAPH.findall(text) or ([text] if text else [])


def leaves_of(paragraph: str, ends: dict[str, bool] | None = None) -> list[str]:
    ends = {} if ends is None else ends
    out, start, at = [], 0, 0
    for token in TOKEN.findall(paragraph):
        at += len(token)
        if (end := ends.get(token)) is None:
            end = ends[token] = not (crc32(token.strip().encode("utf-8", "surrogatepass")) * 0x85EBCA6B >> 13) % MEAN_LEAF
        if end:
            out.append(paragraph[start:at])
            start = at
    if not out or paragraph[start:].strip():
        out.append(paragraph[start:])
    else:
        out[-1] += paragraph[start:]
    return out


def tree(text: str, memory: Memory | None = None) -> Tree:
    """The root, and each section's digest with its paragraphs' leaves."""
    memory = Memory() if memory is None else memory
    sections: list[list[tuple[str, list[str]]]] = [[]]
    for p in paragraphs_of(text):
        digest, leaves, last = memory.paragraph(p)
        sections[-1].append((digest, leaves))
        if last:
            sections.append([])
    made = [(_node("s", [d for d, _ in s]), [leaves for _, leaves in s]) for s in sections if s]
    return hashlib.sha256("".join(["r", *(d for d, _ in made)]).encode()).hexdigest(), made


def _node(level: str, children: list[str]) -> str:
    return hashlib.blake2b("".join([level, *children]).encode(), digest_size=8).hexdigest()


def spell(made: Tree) -> str:
    root, sections = made
    return f"{root}:" + ",".join(f"{digest}({'.'.join('-'.join(p) for p in s)})" for digest, s in sections)


def parse(fingerprint: str) -> Tree:
    root, _, rest = fingerprint.partition(":")
    found = [x.partition("(") for x in rest.split(",") if x]
    return root, [(digest, [p.split("-") for p in body.rstrip(")").split(".")]) for digest, _, body in found]


def likeness(a: str, b: str) -> float:
    """How like two fingerprints are, from 0 to 1."""
    return alike(parse(a), parse(b))


def alike(a: Tree, b: Tree) -> float:
    """Twice the leaves in common over the leaves of both; subtrees with equal digests aren't opened."""
    (root_a, left), (root_b, right) = a, b
    if root_a == root_b:
        return 1.0
    total = sum(len(p) for _, s in left + right for p in s)
    if not total:
        return 0.0
    have = Counter(d for d, _ in left)
    same = have & Counter(d for d, _ in right)
    shared, open_a, open_b = 0, Counter(), Counter()
    for side, out in ((left, open_a), (right, open_b)):
        left_over = Counter(same)
        for digest, s in side:
            if left_over[digest]:
                left_over[digest] -= 1
                shared += sum(map(len, s)) * (side is left)
            else:
                for p in s:
                    out.update(p)
    shared += (open_a & open_b).total()
    return min(1.0, 2.0 * shared / total)


def differing(a: Tree, b: Tree) -> tuple[list[int], list[int]]:
    """Places, in reading order, of the leaves of ``a`` that ``b`` lacks and of those of ``b`` that ``a`` lacks; two empty lists for equal texts.

    Branches with equal digests aren't opened.  Where both have the same leaves, the places at which others stand.
    """
    (root_a, left), (root_b, right) = a, b
    if root_a == root_b:
        return [], []
    same = Counter(d for d, _ in left) & Counter(d for d, _ in right)
    sides = []
    for tree_ in (left, right):
        shut, opened, at = Counter(same), [], 0
        for digest, s in tree_:
            n = sum(map(len, s))
            if shut[digest]:
                shut[digest] -= 1
            else:
                opened += zip(range(at, at + n), (x for p in s for x in p), strict=True)
            at += n
        sides.append(opened)
    both = Counter(x for _, x in sides[0]) & Counter(x for _, x in sides[1])
    out = []
    for opened in sides:
        spare, places = Counter(both), []
        for k, x in opened:
            if spare[x]:
                spare[x] -= 1
            else:
                places.append(k)
        out.append(places)
    if not out[0] and not out[1]:
        flat = [[x for _, s in t for p in s for x in p] for t in (left, right)]
        moved = [k for k, (x, y) in enumerate(zip(*flat, strict=False)) if x != y]
        return moved, list(moved)
    return out[0], out[1]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``SCHEMA`` for each row of ``docs``, beside its edited text and its next document.

    Rows are dealt by ranges of (id, digest), whose bounds come from a bounded draw of these keys; each text is shuffled once, and each
    range is a partition.  The first row of each range is dealt to the range before it as well, as its last row's next.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit(-(2**63)).cast("long")
    # in the order of (id, digest of the text), null ids first
    key = F.concat(F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(F.lpad(F.hex(F.col("doc_id").bitwiseXOR(low)), 16, "0")), F.lit(" "), F.md5(F.col("text").cast("binary")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key)
    keys = settle(rows.select("key"))
    total = keys.count()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    drawn = sorted(r[0] for r in keys.sample(min(1.0, DRAWN * n / total), seed=5).collect())  # some DRAWN * n keys
    bounds = np.array(sorted({drawn[len(drawn) * i // n] for i in range(1, n)}) if drawn else [], dtype="U49")

    @F.pandas_udf("int")
    def slot(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy().astype("U49"), side="right").astype("int32"))

    heads = keys.groupBy(slot("key").alias("slot")).agg(F.min("key").alias("m")).orderBy("slot").collect()  # a row for each range
    firsts = spark.createDataFrame([(r["slot"], r["m"], heads[i - 1]["slot"]) for i, r in enumerate(heads)], "slot int, first string, before int")
    own = F.struct(F.col("slot").alias("slot"), F.lit(0).alias("kind"))
    other = F.struct(F.col("before").alias("slot"), F.lit(1).alias("kind"))
    dealt = (
        rows.withColumn("slot", slot("key")).join(F.broadcast(firsts), "slot").withColumn("to", F.explode(F.when(F.col("key") == F.col("first"), F.array(own, other)).otherwise(F.array(own))))
        .select("to.slot", "to.kind", "key", "doc_id", "text").repartitionById(n, F.col("slot")).sortWithinPartitions("slot", "kind", "key")
    )

    schema = arrow_schema()

    def run(batches):
        out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
        memory = Memory()

        def emit(doc_id, text, made, following, next_made):
            changed = edited(text, following)
            after = tree(changed, memory)
            gone, new = differing(made, after)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            row = (doc_id, len(text), digest, spell(made), spell(after), alike(made, after), alike(made, next_made), sum(len(p) for _, s in made[1] for p in s), min(new or gone, default=None))
            for values, v in zip(out.values(), row, strict=True):
                values.append(v)

        last = done = None  # last: the row that waits for its next; done: the range whose last row has had it
        for batch in batches:
            for slot, kind, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("slot", "kind", "doc_id", "text")), strict=True):
                if kind and slot == done:
                    continue
                made = tree(text, memory)
                if last is not None and last[0] == slot:
                    emit(*last[1:], text, made)
                last = None if kind else (slot, doc_id, text, made)
                done = slot if kind else None
                if len(out["doc_id"]) >= 200:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out.update({k: [] for k in out})
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    return dealt.mapInArrow(run, SCHEMA)


def arrow_schema():
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(SCHEMA))
