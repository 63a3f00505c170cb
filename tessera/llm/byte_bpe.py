"""Byte-level BPE: encoding by folding ranked merges over the bytes of distinct words, decoding by joining binary pieces.

A word's bytes start as single pieces, and a fold merges the neighbours whose joined bytes have the least rank, the leftmost first, until
none has one.  A word that is a token is that token.  ``fold`` states this with Spark's higher-order functions and the ranks as a literal
of the plan (an array of small maps, chosen by hash); it gives the same ids, but takes some 220 to 290 microseconds a word where the limit
leaves about 30, so ``encode`` runs the same fold inside its Arrow batches (see the README for the figures).

Texts are cut into words by the pattern's rules as array operations over code points; only words that a worker has not folded yet are
folded, ``MAX_WORDS`` of them are remembered, and ids are laid back in the documents' order.  Nothing is shuffled; a task holds one piece
of a batch and the remembered words.  Words over ``LONG`` bytes, for which a fold's copies would cost their square, are merged from a heap
with the same results.

Edge cases: a null text is empty; an empty text has no ids.  Null ids are kept.  Repeated rows are encoded each.  Very long texts and
words are encoded whole.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import frugal, in_pieces

BUCKETS, NONE = 8192, 2**31 - 1
#: Words that a task remembers, and bytes from which a word is long.
MAX_WORDS, LONG, SHIFT = 250_000, 96, 1 << 24


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_map(ranks: dict[bytes, int], buckets: int = BUCKETS) -> Column:
    """``array<map<string,int>>``; Spark folds the call into a literal."""
    import xxhash

    made: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        text = token.decode("latin-1")
        made[xxhash.xxh64_intdigest(text.encode(), seed=42) % buckets][text] = rank
    return F.from_json(F.lit(json.dumps(made)), "array<map<string,int>>")


def token_list(ranks: dict[bytes, int]) -> Column:
    size = max(ranks.values(), default=-1) + 1
    pieces = [""] * size
    for token, rank in ranks.items():
        pieces[rank] = token.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(word: Column, table: Column, buckets: int = BUCKETS) -> Column:
    """``array<int>``: the ids of one word, given one character a byte."""
    rank = lambda s: F.coalesce(F.element_at(F.get(table, F.pmod(F.xxhash64(s), F.lit(buckets)).cast("int")), s), F.lit(NONE))

    def step(acc: Column, _: Column) -> Column:
        p, r = acc["p"], acc["r"]

        def merged(i: Column) -> Column:
            def put(new: Column) -> Column:
                left = F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), new)))).otherwise(F.array().cast("array<int>"))
                right = F.when(i < F.size(r), F.array(rank(F.concat(new, F.get(p, i + 1))))).otherwise(F.array().cast("array<int>"))
                return F.struct(
                    F.concat(F.slice(p, F.lit(1), i - 1), F.array(new), F.slice(p, i + 2, F.size(p))).alias("p"),
                    F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(r))).alias("r"),
                )

            return let(F.concat(F.get(p, i - 1), F.get(p, i)), put)

        return let(F.array_min(r), lambda low: F.when(F.coalesce(low, F.lit(NONE)) == NONE, acc).otherwise(let(F.array_position(r, low).cast("int"), merged)))

    chars = F.split(word, "")
    start = let(chars, lambda c: F.struct(c.alias("p"), F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x, i: rank(F.concat(x, F.get(c, i + 1)))).alias("r")))
    many = F.aggregate(F.sequence(F.lit(2), F.length(word)), start, step, lambda acc: F.transform(acc["p"], rank))
    return let(rank(word), lambda whole: F.when(whole != NONE, F.array(whole)).when(F.length(word) < 2, F.array(whole)).otherwise(many))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges from a heap of (rank, place): the least rank, then the leftmost."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = -1 if gone[i] else after[i]
        if j < 0 or end[j] != stop:
            continue
        end[i], gone[j] = stop, 1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i >= 0:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


ENCODED = "doc_id long, ids array<int>"


def pairs_of(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of two neighbours' joined bytes, by their own ranks (left * SHIFT + right)."""
    made = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                made[a * SHIFT + b] = rank
    return made


def merge(word: bytes, ranks: dict[bytes, int], pairs: dict[int, int]) -> list[int]:
    """The ids of one word."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return merge_long(word, ranks)
    get = pairs.get
    parts = [ranks[word[i : i + 1]] for i in range(len(word))]
    near = [get(a * SHIFT + b, NONE) for a, b in zip(parts, parts[1:])]  # noqa: B905
    while near and (low := min(near)) != NONE:
        i = near.index(low)
        parts[i] = low
        del parts[i + 1], near[i]
        if i < len(near):
            near[i] = get(low * SHIFT + parts[i + 1], NONE)
        if i:
            near[i - 1] = get(parts[i - 1] * SHIFT + low, NONE)
    return parts


#: The pattern that ``words_of`` cuts by, other patterns go through the regex module: contractions, letters, numbers, other characters, each
#: run with one blank before it, and white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode has it.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, BLANK = range(4)


@lru_cache(maxsize=1)
def classes():
    import numpy as np
    import unicodedata

    kind = {"L": LETTER, "N": NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], dtype=np.uint8)
    table[WHITE] = BLANK
    return table


def words_of(points):
    """Starts of the words of one text or of several, parted by -1, given by code points.  Texts with contractions aren't for this."""
    import numpy as np

    n = len(points)
    text = points >= 0
    kind = np.where(text, classes()[np.maximum(points, 0)], 9)
    head = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    k = kind[head]
    stop = np.append(head[1:], n)
    after = np.append(k[1:], 9)  # of the run that follows
    blank = k == BLANK
    joins = blank & (points[stop - 1] == 32) & (after != 9)  # its last blank goes to the word that follows
    solid = (k != BLANK) & (k != 9)
    lead = np.append(False, joins[:-1])
    starts = [head[solid] - lead[solid], head[blank & ~(joins & (stop - head == 1))], (stop - 1)[blank & ~joins & (after != 9) & (stop - head > 1)], head[k == 9]]
    return np.sort(np.concatenate(starts))


class Words:
    """Ids of the words that a worker has folded, by word."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: dict[int, int] | None = None):
        import regex

        self.pairs = pairs_of(ranks) if pairs is None else pairs
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.fast = pattern == PATTERN
        self.odd = re.compile("'[stmdrvl]").search
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def of(self, word: str) -> int:
        """The word's number: its ids are ``flat[ends[k] : ends[k + 1]]``."""
        if (k := self.number.get(word)) is None:
            self.flat.extend(merge(word.encode("utf-8", "surrogatepass"), self.ranks, self.pairs))
            k = self.number[word] = len(self.ends) - 1
            self.ends.append(len(self.flat))
        return k

    def encode(self, texts: list[str]):
        """For each text its ids, as an array."""
        import numpy as np

        if len(self.number) > MAX_WORDS:
            self.clear()
        plain = [i for i, t in enumerate(texts) if t and self.fast and not self.odd(t)]
        out: list = [None] * len(texts)
        for i, t in enumerate(texts):
            if t and (not self.fast or self.odd(t)):
                out[i] = self.laid(np.array([self.of(w) for w in self.find(t)], dtype=np.int64))[0]
        for i, ids in zip(plain, self.fold([texts[i] for i in plain]) if plain else (), strict=True):
            out[i] = ids
        return [np.zeros(0, dtype=np.int32) if x is None else x for x in out]

    def laid(self, at):
        """The ids of the words with the numbers ``at``, one after the other, and where each word's begin."""
        import numpy as np

        ids, ends = np.frombuffer(self.flat, dtype=np.int32) if self.flat else np.zeros(0, np.int32), np.frombuffer(self.ends, dtype=np.int64)
        n = ends[at + 1] - ends[at]
        total = np.concatenate([[0], np.cumsum(n)])
        return ids[np.repeat(ends[at] - total[:-1], n) + np.arange(total[-1])], total  # a copy: the arrays can go on growing

    def fold(self, texts: list[str]):
        import numpy as np

        whole = "\0".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.int32).copy()
        sizes = np.array([len(t) for t in texts])
        gaps = (np.cumsum(sizes + 1) - 1)[:-1]
        points[gaps] = -1
        starts = words_of(points)
        bounds = np.append(starts, len(points))
        length = np.diff(bounds)
        # words that hash alike are compared letter by letter with the first of them
        place = np.arange(len(points)) - np.repeat(starts, length)
        hashes = np.add.reduceat(scattered(points, place), starts)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        model = starts[first][which]
        same = length[first][which] == length
        other = np.minimum(np.repeat(model, length) + place, len(points) - 1)
        same &= np.logical_and.reduceat(points[other] == points, starts)
        at = np.zeros(len(first), dtype=np.int64)
        empty = self.of("")
        for k, f in enumerate(first.tolist()):
            a, b = int(bounds[f]), int(bounds[f + 1])
            at[k] = self.of(whole[a:b]) if points[a] >= 0 else empty
        at = at[which]
        for f in np.flatnonzero(~same).tolist():
            at[f] = self.of(whole[int(bounds[f]) : int(bounds[f + 1])]) if points[bounds[f]] >= 0 else empty
        laid, total = self.laid(at)
        text_at = np.concatenate([[0], np.searchsorted(starts, gaps), [len(starts)]])
        cuts = total[text_at]
        return [laid[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def scattered(points, place):
    """A 64-bit number for each code point at each place."""
    import numpy as np

    h = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, ids`` of each row: the ids of its whole text, without special tokens."""
    import numpy as np
    import pyarrow as pa

    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {missing[:5]}")
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pairs_of(ranks)))  # follows the vocabulary's size, not the data's

    def run(batches) -> Iterator[pa.RecordBatch]:
        words = Words(sent.value[0], pattern, sent.value[1])
        for piece in in_pieces(batches, max_bytes=500_000):
            ids = words.encode(piece.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(frugal(run), ENCODED)


def encode_words(words: DataFrame, ranks: dict[bytes, int], column: str = "word") -> DataFrame:
    """``words`` with ``ids``: the same fold in Spark's higher-order functions, for tables of distinct words."""
    table = rank_map(ranks)
    as_bytes = F.decode(F.encode(F.col(column), "UTF-8"), "ISO-8859-1")
    return words.withColumn("ids", F.when(F.length(column) > 0, let(as_bytes, lambda s: fold(s, table))).otherwise(F.array().cast("array<int>")))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The binary text of a column of ids: their pieces, joined."""
    pieces = token_list(ranks)
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")


def digests(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what ``encode`` gives; ids are decoded by joining their pieces."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    sent = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches) -> Iterator[pa.RecordBatch]:
        of = sent.value.__getitem__
        for b in batches:
            n, a, d = [], [], []
            for row in b.column("ids"):
                ids = row.values.to_numpy(zero_copy_only=False) if row.values is not None else np.zeros(0, np.int32)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(b"".join(map(of, ids.tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
