"""Each operator against brute force on small tables, and its edge cases: nulls, empty and long texts, ties, repeats, no rows, more columns."""

import collections
import hashlib
import random

import duckdb
import pytest

from tessera.llm import byte_bpe, embedding_dedup, graph, license_scan, merkle, mixing, ngram_join, quality, queries, substring_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `count` int, `a.b` string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 48, 1, "x"), (2, "one two three four five six seven eight nine ten", "en", "a", 48, 1, "x"), (3, None, None, None, None, None, None), (4, "", "en", "b", 0, 2, "y"),
    (None, "a text without an id, of some words and more words", "en", "b", 10, 2, "y"), (5, LONG, "en", "a", len(LONG), 3, "z"), (5, LONG, "en", "a", len(LONG), 3, "z"), (6, "éè \U0001f600 漢字 \u0000 \n\n x", "de", None, 5, 4, "w"), (7, "x", "en", "c", 1, 5, "v"), (8, " \n\t ", "en", "c", 4, 6, "u"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def words(n, seed, length=400):
    rng = random.Random(seed)
    return [" ".join(f"{rng.choice('bcdfg')}{rng.randrange(5000)}" for _ in range(length)) for _ in range(n)]


# -- components ------------------------------------------------------------------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, i) for i in range(201, 240)] + [(None, 5), (7, 7)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    assert got == {x: top(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 mixing --------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shares", [{"a": 1, "b": 1}, {"a": 5, "b": 2, "c": 1}, {"a": 700, "b": 299, "c": 25}, {"a": 64}])
def test_period_keeps_windows_and_lag(shares):
    plan, q = mixing.period(shares), sum(shares.values())
    slots = sorted(s for x in plan.values() for s, _, _ in x)
    assert slots == list(range(q))
    for name, n in shares.items():
        assert all(r <= s < d for s, r, d in plan[name])
        at = {s for s, _, _ in plan[name]}
        done = 0
        for t in range(q):
            assert abs(n * t / q - done) < 1
            done += t in at


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1.37, "c": 0.001}, {"a": 1, "b": 1, "c": 1}, {str(i): (i + 1) ** 0.7 for i in range(50)}, {"a": 3**0.5}])
def test_a_source_stays_within_a_block_of_its_target(weights):
    """Blocks done against the exact weight times slots, slot by slot, over many periods."""
    plan = mixing.Schedule(mixing.exact(weights))
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    at_ends = [p for p in range(30)] + [10**6, 10**6 + 1, 10**9]
    for p in at_ends:
        first, times = plan.plan(p)
        assert sum(first) == plan.q * p and sorted(s for x in times.values() for s, _, _ in x) == list(range(plan.q))
        by_slot = {s: k for k, x in times.items() for s, _, _ in x}
        done = dict(zip(plan.names, first, strict=True))
        assert all(r <= s < d for x in times.values() for s, r, d in x)
        for slot in range(plan.q):
            t = plan.q * p + slot
            assert all(abs(done[k] - w * t / total) < 2 for k, w in weights.items())  # two halves are a block
            done[by_slot[slot]] += 1
    for k in weights:
        first, times = plan.plan(7)
        assert [plan.place(k, first[plan.index[k]] + j) for j in range(len(times[k]))] == [tuple(7 * plan.q + x for x in t) for t in times[k]]


def test_mix_against_one_long_schedule(spark):
    """Every row's slot against a plain run of all slots, one after the other."""
    rows = [(i, "ab"[i % 3 > 0]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 1.0, "b": 2.3}
    got = mixing.mix(docs, weights, block_rows=4, rows_per_range=50, slots_per_source=8).collect()
    plan, want = mixing.Schedule(mixing.exact(weights), 8), {}
    for p in range(40):
        first, times = plan.plan(p)
        for k, x in times.items():
            for j, (s, r, d) in enumerate(x):
                want[k, first[plan.index[k]] + j] = (p * plan.q + s, p * plan.q + r, p * plan.q + d)
    assert len(got) == len(rows) and all(want[r["source"], r["mix_block"]] == (r["mix_slot"], r["mix_release"], r["mix_deadline"]) for r in got)
    for k in "ab":
        places = sorted((r["mix_block"], r["mix_in_block"]) for r in got if r["source"] == k)
        assert places == [(i // 2, i % 2) for i in range(len(places))]


def test_mix_is_whole_and_in_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").drop("text")
    rows = mixing.mix(docs, {f"src{i}": 1 + i for i in range(20)}, block_rows=2, rows_per_range=4).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    blocks = collections.defaultdict(list)
    for r in rows:
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
        blocks[r["source"], r["mix_block"]].append((r["mix_slot"], r["mix_in_block"]))
    assert all(len({s for s, _ in b}) == 1 and sorted(k for _, k in b) == list(range(len(b))) for b in blocks.values())
    by = collections.Counter(k[0] for k in blocks)
    assert all({b for s, b in blocks if s == name} == set(range(n)) for name, n in by.items())
    assert len({b[0][0] for b in blocks.values()}) == len(blocks)


def test_mix_edges(odd, none):
    got = mixing.mix(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() == len(ODD)
    assert mixing.mix(none).count() == 0
    by = {(r["doc_id"], r["text"]): (r["mix_slot"], r["mix_in_block"]) for r in got.collect()}
    assert len(set(by.values())) == len(by) == len(ODD) - 1 and len({(r["mix_slot"], r["mix_in_block"]) for r in got.collect()}) == len(ODD)
    assert mixing.mix(odd, {"": 1, "a": 2, "b": 3, "c": 4}).where("source is null").count() == 2
    for bad in ({"a": 1.0}, {"": 1, "a": 1e-9, "b": 1, "c": 1}):
        with pytest.raises(ValueError):
            mixing.mix(odd, bad)
    again = mixing.mix(got)
    assert again.columns == [*got.columns, *(f"_{c}" for c in mixing.MADE)] and again.count() == len(ODD)


# -- 2 substring dedup -----------------------------------------------------------------------------------------------------------------


def test_gear_matches_the_rolling_definition():
    import numpy as np

    table, data = substring_dedup.gear_table(), np.frombuffer(bytes(range(256)) * 2, dtype=np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (h * 2 + int(table[b])) % 2**32
        want.append(h)
    assert substring_dedup.gear(data, table).tolist() == want


def test_cuts_are_whole_and_resist_shifts():
    import numpy as np

    text = words(1, 3, 2000)[0] + "漢字" * 300
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    ends = substring_dedup.cuts(raw)
    assert ends[-1] == len(raw) and ends == sorted(set(ends)) and max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= substring_dedup.MAX_CHUNK
    for a, b in zip([0, *ends], ends, strict=False):
        raw[a:b].tobytes().decode()
    more = np.frombuffer(("inserted " + text).encode(), dtype=np.uint8)
    pieces = lambda r, e: [r[a:b].tobytes() for a, b in zip([0, *e], e, strict=False)]
    assert len(set(pieces(raw, ends)) - set(pieces(more, substring_dedup.cuts(more)))) <= 3


def test_passages_and_cut(spark):
    base, shared = words(6, 5), words(1, 77, 60)[0]
    rows = [(i, t if i in (0, 3) else t[:500] + " " + shared + " " + t[500:]) for i, t in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["owner_id"]) for r in substring_dedup.passages(docs).collect()}
    assert got == {(2, 1), (4, 1), (5, 1)}
    after = {r["doc_id"]: r["text"] for r in substring_dedup.cut(docs).collect()}
    assert all(after[i] == rows[i][1] for i in (0, 1, 3))
    for i in (2, 4, 5):
        assert len(rows[i][1]) - len(after[i]) >= 0.5 * len(shared)
        left = iter(rows[i][1])
        assert all(c in left for c in after[i])  # a subsequence: nothing is moved or added
        assert base[i][:400] in after[i] and base[i][-400:] in after[i]


def test_anchors_leave_no_passage_out():
    import numpy as np

    rng = random.Random(8)
    for k in range(200):
        shared = "".join(rng.choice("abcdefgh ") for _ in range(substring_dedup.MIN_RUN))
        texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300))) + "|" + shared + "|" + "".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(2)]
        at = [t.index("|" + shared) + 1 for t in texts]
        inside = [{i - a for i in substring_dedup.anchors(np.frombuffer(t.encode(), dtype=np.uint8)).tolist() if 0 <= i - a <= len(shared) - substring_dedup.SEED_BYTES} for t, a in zip(texts, at, strict=True)]
        assert inside[0] & inside[1]


def test_short_passages_are_cut_whole(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("bcdfgx") + str(rng.randrange(5000)) + rng.choice(["", "é", "漢"])
    rows, want = [], []
    for k in range(150):  # each passage of 51 words in two documents, between other words
        passage = " ".join(word() for _ in range(51))
        for copy in range(2):
            head, tail = (" ".join(word() for _ in range(200)) for _ in range(2))
            rows.append((2 * k + copy, f"{head} {passage} {tail}"))
            want.append((head, passage, tail))
    got = {r["doc_id"]: r["text"] for r in substring_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (head, _, tail) in enumerate(want):
        if i % 2 == 0:
            assert got[i] == rows[i][1]
        else:  # equal bytes on either side go with the passage: the spaces at least
            assert got[i].startswith(head[:-20]) and got[i].endswith(tail[20:]) and len(head) + len(tail) - 20 <= len(got[i]) <= len(head) + len(tail)


def test_passages_against_brute_force(spark, small):
    """Bytes in a window of MIN_RUN bytes that an earlier document has, or the document itself has earlier."""
    n = substring_dedup.MIN_RUN
    rng = random.Random(12)
    rows = [*small[:90], (500, small[3][1]), (501, "é漢 " + small[5][1][40:] + " end"), (502, " ".join([words(1, 60, 30)[0]] * 3)), (502, "another text of the same id")]
    shared = words(3, 61, 40)
    rows += [(600 + k, f"{words(1, 70 + k, 50)[0]} {rng.choice(shared)} {words(1, 90 + k, 20)[0]} {rng.choice(shared)[:150]} {words(1, 110 + k, 20)[0]}") for k in range(20)]
    got = collections.defaultdict(set)
    for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["start"] + r["size"]))
    seen, found, all_ = set(), 0, 0
    for i, text in sorted((r for r in rows if r[1] != "another text of the same id"), key=lambda r: r[0]):
        raw, own, want = text.encode(), set(), set()
        for k in range(len(raw) - n + 1):
            w = raw[k : k + n]
            if w in seen or w in own:
                want |= set(range(k, k + n))
            own.add(w)
        seen |= own
        assert got[i] <= want
        found, all_ = found + len(got[i]), all_ + len(want)
    assert all_ > 10_000 and found >= 0.995 * all_


def test_a_long_run_of_one_byte_is_cut_to_its_first(spark):
    docs = spark.createDataFrame([(1, "a" * 20_000), (2, "b" + "a" * 30_000 + "c")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.cut(docs).collect()}
    assert 0 < len(got[1]) <= 40 and len(got[2]) <= 40 and got[2][0] == "b" and got[2][-1] == "c"


def test_cut_edges(spark, odd, none):
    got = substring_dedup.cut(odd)
    assert got.columns == odd.columns and got.count() == len(ODD)
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r["text"])
    assert by[3] == [None] and by[4] == [""] and by[5][0] == by[5][1]
    assert substring_dedup.cut(none).count() == 0 and substring_dedup.passages(none).count() == 0
    twice = spark.createDataFrame([(1, words(1, 9)[0]), (2, words(1, 9)[0])], "doc_id long, text string")
    assert sorted(len(r["text"]) for r in substring_dedup.cut(twice).collect())[0] == 0


# -- 3 embeddings ----------------------------------------------------------------------------------------------------------------------


def clusters(seed=1, n=700, dim=16):
    import numpy as np

    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    for k, size in ((0, 120), (200, 30), (300, 2), (310, 3)):
        v[k : k + size] = v[k] + rng.normal(size=(size, dim)) * 0.12
    v[400], v[401] = v[0] * 7, v[200]
    return v


def test_links_against_brute_force(spark):
    import numpy as np

    v = clusters()
    made = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.links(made, shard=60, part=50).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(got[i]["n_links"] != near[i].sum() for i in range(len(v))) <= 0.02 * len(v)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(v)))
    component = list(range(len(v)))
    for _ in range(20):
        component = [min([component[i], *(component[j] for j in np.flatnonzero(near[i]))]) for i in range(len(v))]
    assert sum(got[i]["component_id"] != component[i] for i in range(len(v))) <= 0.02 * len(v)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.audit(made, embedding_dedup.links(made), 50) >= 0.9


def test_links_across_shards_are_whole(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    n, dim = 3000, 64
    v = rng.normal(size=(n, dim))
    v[:1000] = v[0] / np.linalg.norm(v[0]) + rng.normal(size=(1000, dim)) * 0.27 / 8  # mutual cosine about 0.93, dealt to many shards
    v[2000:] = v[1000:2000] + rng.normal(size=(1000, dim)) * 0.42  # pairs near 0.92
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    monkeypatch.setattr(embedding_dedup.across, "__defaults__", (700,))  # several blocks
    made = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.links(made, shard=50).collect()}
    assert [got[i] for i in range(n)] == near.sum(1).tolist()


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (11, [1e-200, 0.0]), (12, [0.0, 1e300])]
    got = embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert by[1]["n_links"] == by[2]["n_links"] == by[11]["n_links"] == by[None]["n_links"] == 4 and by[11]["component_id"] == 1
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (3, 4, 5, 6, 7, 8, 9, 12))
    assert embedding_dedup.links(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# -- 4 n-gram join ---------------------------------------------------------------------------------------------------------------------


def brute_links(rows):
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n, root = collections.Counter(), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
                p, q = a, b
                while root[p] != p:
                    p = root[p]
                while root[q] != q:
                    q = root[q]
                root[max(p, q)] = min(p, q)
    return n, root


def test_links_of_documents(spark, small, monkeypatch):
    rng = random.Random(8)
    rows = list(small)
    base = words(1, 21, 120)[0].split()
    for k in range(60):  # a large group of near copies, in several blocks
        w = list(base)
        w[rng.randrange(len(w))] = f"new{k}"
        rows.append((10_000 + k, " ".join(w)))
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 16)
    got = {r["doc_id"]: r for r in ngram_join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n, root = brute_links(rows)
    for k, (i, _) in enumerate(rows):
        top = k
        while root[top] != top:
            top = root[top]
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[k], rows[top][0], rows[top][0] == i)


def test_join_edges(odd, none):
    got = ngram_join.links(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == by[2]["class_id"] == 1 and by[1]["n_links"] == 1 and by[5]["n_links"] == 1
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (3, 4, 7, 8, None))
    kept = ngram_join.representatives(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect() if r["doc_id"] != 5) == [0, 1, 3, 4, 6, 7, 8]
    assert ngram_join.links(none).count() == 0 and ngram_join.representatives(none).count() == 0
    assert 1 - (1 - 0.8**5) ** ngram_join.bands_for() >= 0.999


def test_representatives_by_id_and_text(spark):
    a, b, c, d, e = words(5, 31, 60)
    near = a + " end"
    rows = [(1, a, "x"), (None, a, "x"), (None, b, "x"), (7, near, "x"), (7, c, "x"), (9, d, "x"), (9, d, "x"), (None, e, "x"), (None, e + " end", "x"), (None, e, "y"), (3, "", "x"), (3, "", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    kept = ngram_join.representatives(docs)
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns
    one = [r for r in got if r[1] in (e, e + " end")]
    assert len(one) == 1 and one[0] in rows
    rest = [(1, a, "x"), (None, b, "x"), (7, c, "x"), (9, d, "x"), (3, "", "x"), (3, "", "x"), (None, None, "x")]
    assert sorted(map(str, (r for r in got if r not in one))) == sorted(map(str, rest))


# -- 5 quality -------------------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    got = queries.op5_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").df()
    both = got[got.held_out].merge(labels, on="doc_id")
    good, bad = both[both.quality == 1].score, both[both.quality == 0].score
    assert sum(int(g > b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert (good >= 0.3).mean() >= 0.97 and got.score.between(0, 1).all() and len(got) == 1000


def test_rules_compile_to_what_they_say(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    from tessera.llm.bytewise import STATISTICS

    x = rng.random((300, len(STATISTICS)))
    model = quality.learn(x, ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{k} double" for k in STATISTICS))
    got = [r[0] for r in rows.select(model.column(lambda k: rows[k])).collect()]
    for r, s in zip(x, got, strict=True):
        z = model.intercept + sum(rule.weight for rule in model.rules if all((r[STATISTICS.index(k)] <= t) == below for k, below, t in rule.conditions))
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9
    assert 0 < len(model.rules) < 60


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    kept = quality.keep(odd, labels)
    assert kept.columns == odd.columns and kept.count() == len(ODD)  # no usable label: 0.5 each
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    assert quality.score(odd, quality.fit(odd, labels)).count() == len(ODD)
    assert quality.keep(none, labels).count() == 0


# -- 6 toxicity ------------------------------------------------------------------------------------------------------------------------


def test_marginals_against_the_plain_chain():
    import numpy as np

    model = toxicity.Model({}, [], -2.0, [[0.3, -1.0], [-0.4, 0.8]], [])
    rng = np.random.default_rng(3)
    rows, want = [], []
    for n, places in ((1, [0]), (7, [0, 1, 6]), (40, [3, 4, 20]), (300, [150, 299]), (5, []), (12, [5])):
        e = np.full(n, -2.0)
        e[places] = rng.normal(size=len(places)) * 2
        move = np.exp(np.array(model.moves))
        heat = np.stack([np.ones(n), np.exp(e)], 1)
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        a[0] = heat[0]
        for t in range(1, n):
            a[t] = (a[t - 1] / a[t - 1].sum()) @ move * heat[t]
        for t in range(n - 2, -1, -1):
            b[t] = move @ (b[t + 1] * heat[t + 1])
            b[t] /= b[t].sum()
        p = a * b
        want.append((p[:, 1] / p.sum(1))[places])
        rows.append((n, [(i, float(e[i])) for i in places]))
    for got, w in zip(toxicity.marginals(model, rows), want, strict=True):
        assert np.allclose(got, w)


def test_toxic_documents_are_found(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        w = words(1, 1000 + i, 80)[0].split()
        if i % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["nastyword", "Vileword!", "scornful"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    for r in got:
        assert (r["score"] >= 0.5) == (r["doc_id"] % 5 == 0)
        marked = {rows[r["doc_id"]][1][s["start"] : s["end"]].lower() for s in r["spans"]}
        assert marked <= {"nastyword", "vileword", "scornful"} and bool(marked) == (r["doc_id"] % 5 == 0)


def test_spans_of_letters_that_lower_casing_lengthens():
    model = toxicity.Model({"nasty": 0}, [8.0], -4.0, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0, 0.0, 0.0, 0.0])
    for text in ("İstanbul nasty word", "a İİİ b NASTY", "nasty"):
        _, n, _, spans = toxicity.score_texts(model, [text])[0]
        assert n == len(toxicity.offsets_of(text)) and [text[a:b].lower() for a, b in spans] == ["nasty"]


def test_one_long_text_widens_nothing():
    import numpy as np

    model = toxicity.Model({}, [], -2.0, [[0.3, -1.0], [-0.4, 0.8]], [])
    rows = [(5, [(2, 1.0)])] * 3000 + [(400_000, [(i, 0.5) for i in range(0, 400_000, 2)])]
    got = toxicity.marginals(model, rows)  # together these would be 3,001 rows of 200,000 places
    assert len(got[-1]) == 200_000 and np.allclose(got[0], toxicity.marginals(model, rows[:1])[0])


def test_the_likelihoods_slope_against_differences():
    """The learner's slope beside that of the plain likelihood: the score of the labels less the log of the sum over all paths."""
    import itertools

    import numpy as np

    rows = [{"n": 5, "at": [1, 1, 3], "f": [0, 1, 2], "t": [1, 1, 0]}, {"n": 3, "at": [], "f": [], "t": []}, {"n": 3, "at": [], "f": [], "t": []}, {"n": 4, "at": [0, 3], "f": [1, 1], "t": [1, 1]}]
    rng = np.random.default_rng(4)
    w = rng.normal(size=3 + 5) * 0.5

    def likelihood(w):
        total = 0.0
        for r in rows:
            e = np.full(r["n"], w[-5])
            y = np.zeros(r["n"], dtype=int)
            for i, f, t in zip(r["at"], r["f"], r["t"], strict=True):
                e[i] += w[f]
                y[i] = t
            score = lambda path: sum(e[i] for i, s in enumerate(path) if s) + sum(w[-4:].reshape(2, 2)[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, B905, E731
            total += score(y) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=r["n"])))
        return total

    windows, many = toxicity._windows(rows)
    assert sum(many) == 4 and max(many) == 2
    seen = {}
    kept = toxicity._slope

    def spy(at, *rest):
        seen.setdefault("g", kept(w, *rest))
        return kept(at, *rest)

    toxicity._slope = spy
    try:
        toxicity._learn(rows, {"a": 0, "b": 1, "c": 2})
    finally:
        toxicity._slope = kept
    want = [(likelihood(w + d) - likelihood(w - d)) / 2e-5 for d in np.eye(8) * 1e-5]
    assert np.allclose(seen["g"], want, atol=1e-4)


def test_toxicity_edges(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, empty)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, None)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == len(ODD)


# -- 7 fingerprints --------------------------------------------------------------------------------------------------------------------


def test_fingerprints_against_the_contract(spark, sf, small):
    got = {r["doc_id"]: r for r in merkle.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len(got) == len(small)
    marks = {}
    for k, (i, text) in enumerate(small):
        following = small[(k + 1) % len(small)][1]
        half = len(text) // 2
        after = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(after.encode()).hexdigest())
        assert r["fingerprint"] == merkle.spell(merkle.tree(text)) and r["edited_fingerprint"] == merkle.spell(merkle.tree(after))
        assert r["near_edited"] == merkle.likeness(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == merkle.likeness(r["fingerprint"], got[small[(k + 1) % len(small)][0]]["fingerprint"])
        assert marks.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        # likeness by leaves alone, written out plainly
        leaves = [collections.Counter(x for p in merkle.paragraphs_of(t) for x in merkle.leaves_of(p)) for t in (text, after)]
        assert text == after or abs(r["near_edited"] - 2 * (leaves[0] & leaves[1]).total() / max(1, sum(c.total() for c in leaves))) < 0.05


def test_a_tree_is_the_text_and_its_roots_those_of_its_branches():
    rng = random.Random(3)
    texts = ["", " ", "\n", "a", "a\n", " a\n\n b\n  \n", "\n\n x y\n", "a\r\n\r\nb", "x\u2028y\n\x1c\nz", *("".join(rng.choice("ab  \n\té") for _ in range(rng.randrange(80))) for _ in range(500))]
    roots = {}
    for t in texts:
        assert "".join(merkle.paragraphs_of(t)) == t and all("".join(merkle.leaves_of(p)) == p for p in merkle.paragraphs_of(t))
        root, sections = merkle.tree(t)
        for digest, s in sections:
            assert digest == merkle._node("s", [merkle._node("p", p) for p in s])
        assert root == hashlib.sha256(("r" + "".join(d for d, _ in sections)).encode()).hexdigest()
        assert roots.setdefault(root, t) == t
        assert merkle.parse(merkle.spell((root, sections))) == (root, sections)
    assert len(roots) == len(set(texts))


def test_differing_branches_locate_an_edit():
    text = "\n".join(words(12, 2, 40))
    w = text.split()
    lines = text.split("\n")
    a = merkle.tree(text)
    assert merkle.differing(a, a) == ([], [])
    edits = {"word": text.replace(w[100], "changed", 1), "blank": text.replace(w[100] + " ", w[100] + "  ", 1), "line end": text + "\n", "blank line": text.replace("\n", "\n\n", 1), "deletion": text.replace(w[100] + " ", "", 1), "lines gone": "\n".join(lines[:3] + lines[4:])}
    for after in edits.values():
        gone, new = merkle.differing(a, merkle.tree(after))
        assert 1 <= len(gone) + len(new) <= 30 and 0.5 < merkle.alike(a, merkle.tree(after)) < 1
    assert all(len(merkle.differing(a, merkle.tree(edits[k]))[1]) <= 2 for k in ("word", "blank", "line end", "blank line", "deletion"))
    gone, new = merkle.differing(a, merkle.tree("\n".join([lines[1], lines[0], *lines[2:]])))
    assert gone == new and gone  # nothing but places changed
    assert merkle.likeness(merkle.spell(merkle.tree("")), merkle.spell(merkle.tree(""))) == 1 and merkle.likeness(merkle.spell(merkle.tree("")), merkle.spell(a)) == 0


def test_fingerprints_of_repeated_ids(spark):
    rows = [(None, f"text {i % 7}") for i in range(40)] + [(5, f"other {i}") for i in range(40)] + [(5, "same")] * 10 + [(-3, "low"), (2**62, "high")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    want = collections.Counter((i, hashlib.sha256(merkle.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    got = collections.Counter((r["doc_id"], r["edited_sha256"]) for r in merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want


def test_fingerprint_edges(spark, odd, none):
    got = merkle.fingerprints(odd).collect()
    assert len(got) == len(ODD) and sorted(r["n_chars"] for r in got) == sorted(len(r[1] or "") for r in ODD)
    assert merkle.fingerprints(none).count() == 0
    one = merkle.fingerprints(spark.createDataFrame([(3, "only this text")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"only thonly th").hexdigest()


# -- 8 byte-level BPE ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_are_cut_and_merged_as_the_library_does(vocabulary):
    ranks, pattern, library = vocabulary
    words = byte_bpe.Words(ranks, pattern)
    rng = random.Random(1)
    alphabet = "ab éß1٢½ \n\t  .,!'stLLd　\u0085\x1c漢\U0001f600ń\0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["a" * 3000, " " * 300 + "x", "é" * 500, "", "don't we'll", "\n\n"]
    for k in range(0, len(texts), 100):
        for t, ids in zip(texts[k : k + 100], words.encode(texts[k : k + 100]), strict=True):
            assert ids.tolist() == library.encode_ordinary(t)
    other = byte_bpe.Words(ranks, r"\w+|\W+")
    assert sum((merge for w in ("ab", " .", "c") for merge in [byte_bpe.merge(w.encode(), ranks, other.pairs)]), []) == other.encode(["ab .c"])[0].tolist()
    word = bytes(rng.choice(b"abcdefghij \xc3\xa9") for _ in range(90))
    assert byte_bpe.merge_long(word, ranks) == byte_bpe.merge(word, ranks, other.pairs)


def test_words_that_hash_alike_keep_their_own_ids(vocabulary, monkeypatch):
    import numpy as np

    ranks, pattern, library = vocabulary

    def thue_morse(n, x, y):
        return x if n == 0 else thue_morse(n - 1, x, y) + thue_morse(n - 1, y, x)

    a, b = thue_morse(10, "a", "b"), thue_morse(10, "b", "a")
    texts = [a, b, f"{a} {b} {a}", "one two one two three", "x", ""]
    words = byte_bpe.Words(ranks, pattern)
    assert [x.tolist() for x in words.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "scattered", lambda points, place: np.zeros(len(points), dtype=np.uint64))  # all words clash
    words = byte_bpe.Words(ranks, pattern)
    assert [x.tolist() for x in words.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_hashes_of_words_follow_no_structure():
    import numpy as np

    from tessera.llm import bytewise

    def thue_morse(n, x, y):
        return x if n == 0 else thue_morse(n - 1, x, y) + thue_morse(n - 1, y, x)

    a, b = thue_morse(11, b"a", b"b"), thue_morse(11, b"b", b"a")
    data = np.frombuffer(b" ".join([a, b, a, b"ab", b"ba", b"ab"]), dtype=np.uint8)
    _, lengths, hashes, _ = bytewise.words(data, np.array([0, len(data)]))
    assert lengths.tolist() == [2048] * 3 + [2] * 3 and hashes[0] == hashes[2] and hashes[3] == hashes[5] and len(set(hashes.tolist())) == 4


def test_the_fold_in_higher_order_functions_agrees(spark, small, vocabulary):
    ranks, pattern, library = vocabulary
    import regex

    some = sorted({w for _, t in small[:6] for w in regex.findall(pattern, t)})[:250] + ["\U0001f600", " ", "漢字é", "x" * 40]
    rows = byte_bpe.encode_words(spark.createDataFrame([(w,) for w in some], "word string"), ranks).collect()
    assert all(r["ids"] == library.encode_ordinary(r["word"]) for r in rows) and len(rows) == len(some)


def test_encode_query_and_decode(spark, sf, small, vocabulary):
    ranks, pattern, library = vocabulary
    got = {r["doc_id"]: r for r in queries.op8_byte_bpe(spark, sf).collect()}
    import numpy as np

    for i, text in small:
        ids = library.encode_ordinary(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    made = byte_bpe.encode(spark.createDataFrame(small[:5], "doc_id long, text string"), ranks, pattern)
    assert {r[0]: bytes(r[1]).decode() for r in made.select("doc_id", byte_bpe.decode(made["ids"], ranks)).collect()} == dict(small[:5])


def test_encode_edges(odd, none, vocabulary):
    ranks, pattern, library = vocabulary
    got = byte_bpe.encode(odd, ranks, pattern).collect()
    assert sorted(map(list, ((r["ids"]) for r in got))) == sorted(library.encode_ordinary(r[1] or "") for r in ODD)
    assert byte_bpe.encode(none, ranks, pattern).count() == 0 and byte_bpe.digests(byte_bpe.encode(none, ranks, pattern), ranks).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(odd, {b"a": 0}, pattern)


# -- 9 URL filter ----------------------------------------------------------------------------------------------------------------------


def test_rules_and_aliases(spark):
    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    refresh = '<meta http-equiv="refresh" content="0; url=/x/target">'
    rows = [
        (1, "http://a.NET/x?q", ""), (2, "http://example.net/en/1", ""), (3, "http://example.net/de/1", ""), (4, "http://example.com/de/#f", ""), (5, "http://w.org/fr/", None), (6, "no url", ""), (7, None, None),
        (8, "http://alias.com/p", link("http://bad.net/y")), (9, "http://chain.com/q", link("http://alias.com/p")), (10, "http://example.net/en/2", link("http://bad.net/y")), (11, "http://r.com/1", refresh), (12, "http://r.com/x/target", ""),
        (13, "https://x.net", ""), (14, "http://notexample.com/de/", ""), (15, "http://bad.net", link("//alias.com/p")), (1, "http://a.NET/x?q", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert url_filter.judge(pages).count() == len(rows)
    verdicts = {1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: ("net/", "block"), 4: ("example.com/de/", "block"), 5: ("org/fr/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "block"), 10: ("example.net/en/", "allow"), 11: (None, "allow"), 13: (None, "allow"), 14: (None, "allow"), 15: (None, "block")}
    assert {k: (got[k]["rule"], got[k]["verdict"]) for k in verdicts} == verdicts
    assert (got[1]["host"], got[1]["path"], got[13]["path"], got[6]["host"]) == ("a.net", "/x", "", "")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    cols = ["page_id", "host", "path", "rule", "verdict", "via_alias"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({url_filter.oracle_sql()})").fetchall()
    assert sorted(want, key=repr) == sorted((tuple(r[c] for c in cols) for r in url_filter.judge(pages).collect()), key=repr)
    assert url_filter.judge(pages.limit(0)).count() == 0


# -- 10 licences -----------------------------------------------------------------------------------------------------------------------


def test_scan_against_plain_python(spark, small, odd, none):
    texts = [(90_000 + i, f"some words before. {t} and some after\nnothing here\n{t}") for i, t in enumerate(sum(license_scan.TEMPLATES.values(), []))] + [(91_000 + i, t) for i, t in enumerate(license_scan.NONE)]
    rows = small + texts
    got = collections.defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["paragraph"], r["family"], round(r["similarity"], 6), r["confirmed"]))
    for i, t in rows:
        assert sorted(got[i]) == sorted(license_scan.plain(t))
    assert license_scan.scan(none).count() == 0
    license_scan.scan(odd).collect()


def test_families_are_told_apart():
    for name, texts in license_scan.TEMPLATES.items():
        for t in texts:
            assert [x[1] for x in license_scan.plain(f"it was so that {t} they said of the time")] == [name]
    assert all(x[1] == "unknown" for t in license_scan.NONE for x in license_scan.plain(t))
