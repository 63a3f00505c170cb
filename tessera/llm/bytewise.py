"""Words, hashes and statistics of many texts at once, as array operations over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from tessera.llm.common import SPACES

_rng = np.random.default_rng(20_240_229)
#: A random number for each byte at each of a run's first places; further places are mixed from byte and place.
PLACES = 512
TABLE = _rng.integers(0, 2**64, (PLACES, 256), dtype=np.uint64)
STEPS = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[ord(c) for c in SPACES]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that aren't ``apart``, never across rows: starts, lengths, 64-bit hashes, and each row's first run (with the end).

    A hash is the sum of a random number for each byte and place, so no structure of the texts makes two runs clash.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~apart
    heads = inside.copy()
    heads[1:] &= apart[:-1]
    fresh = bounds[:-1][bounds[:-1] < n]
    heads[fresh] |= inside[fresh]
    starts = np.flatnonzero(heads)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    lengths = np.add.reduceat(inside.astype(np.int64), starts)
    place = np.arange(n, dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, n)))
    place[: starts[0]] = 0
    place[apart] = 0
    values = TABLE.reshape(-1)[(np.minimum(place, PLACES - 1) << 8) + data]
    if len(far := np.flatnonzero(place >= PLACES)):
        values[far] = mixed(values[far] ^ mixed(place[far].astype(np.uint64)))
    values[apart] = 0
    return starts, lengths, mixed(np.add.reduceat(values, starts)), np.searchsorted(starts, bounds)


def words(data: np.ndarray, bounds: np.ndarray):
    return runs(data, bounds, SPACE[data])


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word n-grams (a row of 1 to n - 1 words has one, of all its words), and each row's first (with the end)."""
    counts = np.diff(first)
    made = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for k in range(n):
        made += hashes[k : k + len(made)] * STEPS[k]
    made = mixed(made)
    many = np.maximum(counts - n + 1, 0)
    per = np.where(counts >= n, many, (counts > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(ends[-1], dtype=np.uint64)
    long_ = counts >= n
    source = np.repeat(first[:-1][long_] - np.concatenate([[0], np.cumsum(many[long_])])[:-1], many[long_]) + np.arange(many[long_].sum())
    target = np.repeat(ends[:-1][long_] - np.concatenate([[0], np.cumsum(many[long_])])[:-1], many[long_]) + np.arange(many[long_].sum())
    out[target] = made[source]
    for i in np.flatnonzero((counts > 0) & ~long_).tolist():
        h = hashes[first[i] : first[i + 1]]
        out[ends[i]] = mixed((h * STEPS[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))[0]
    return out, ends


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    t[[ord(c) for c in chars]] = 1
    return t


_letters = np.zeros(256, dtype=np.uint8)
_letters[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = 1
_heads = np.ones(256, dtype=np.uint8)
_heads[0x80:0xC0] = 0
CLASSES = {
    "chars": _heads, "letters": _letters, "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _class("0123456789"), "spaces": SPACE.astype(np.uint8), "lines": _class("\n"),
    "stops": _class(".?!"), "commas": _class(",;:"), "marks": _class("!"), "pipes": _class("|"), "signs": _class("#$%&*@^~<>{}[]\\/=+_"), "wide": (np.arange(256) >= 0xC2).astype(np.uint8),
}
STATISTICS = ["log_chars", "word_length", "upper", "digits", "letters", "stops", "commas", "marks", "pipes", "signs", "wide", "line_length", "distinct_words", "top_word", "repeated_lines", "distinct_grams", "long_words", "stop_gap"]


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many different values it has, and how often the most frequent one occurs."""
    rows = len(first) - 1
    n, top = np.zeros(rows), np.zeros(rows)
    if not len(hashes):
        return n, top
    # one sort of row number and upper hash bits together
    bits = np.uint64(max(1, int(rows).bit_length()))
    keys = (np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first)) << (np.uint64(64) - bits)) | (hashes >> bits)
    keys.sort()
    r = (keys >> (np.uint64(64) - bits)).astype(np.int64)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(keys)))
    owner = r[at]
    n += np.bincount(owner, minlength=rows)
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    top[owner[begins]] = np.maximum.reduceat(counts, begins)
    return n, top


def statistics(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """``STATISTICS`` of each row, all finite; an empty row has zeros."""
    spread = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]) if len(bounds) > 1 else np.zeros((0, 256), np.int64)
    c = {k: (spread @ t).astype(float) for k, t in CLASSES.items()}
    some = np.maximum(c["chars"], 1)
    _, lengths, hashes, first = words(data, bounds)
    n = np.maximum(np.diff(first), 1)
    kinds, top = distinct(hashes, first)
    grams, gram_first = shingles(hashes, first, 3)
    gram_kinds, _ = distinct(grams, gram_first)
    _, _, line_hashes, line_first = runs(data, bounds, data == 10)
    lines = np.maximum(np.diff(line_first), 1)
    line_kinds, _ = distinct(line_hashes, line_first)
    has = np.diff(first) > 0
    return {
        "log_chars": np.log1p(c["chars"]), "word_length": (c["chars"] - c["spaces"]) / n, "upper": c["upper"] / some, "digits": c["digits"] / some, "letters": c["letters"] / some, "stops": c["stops"] / n, "commas": c["commas"] / n, "marks": c["marks"] / n,
        "pipes": c["pipes"] / n, "signs": c["signs"] / n, "wide": c["wide"] / some, "line_length": c["chars"] / lines, "distinct_words": kinds / n, "top_word": top / n, "repeated_lines": np.where(has, 1 - line_kinds / lines, 0.0),
        "distinct_grams": gram_kinds / np.maximum(np.diff(gram_first), 1), "long_words": sums_of(lengths >= 20, first) / n, "stop_gap": n / (c["stops"] + 1),
    }


def sums_of(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
