"""Operators over whole collections against brute force, with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm.components import components
from pagemill.llm.exchange import Fan, _packed_counts, _packed_keys, _unpacked_counts, _unpacked_keys, finished, totals
from pagemill.llm.lattice import Lattice, _units, _verified, e8, fitted, near_vectors, neighbours
from pagemill.llm.lm_score import lm_score
from pagemill.llm.ngram_join import shingle_sets, similar_texts, spanning_links
from pagemill.llm.substring_dedup import remove_repeats
from pagemill.llm.suffixes import adjacent_prefixes, suffix_array

CLASH = "doc_id long, text string, _id string, _text string, _n long, _set string, _hash long, learned string, _block int"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TOKEN = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "x", "y", 1, "z", 2, "w", 3) for i, t in enumerate(texts)], CLASH)


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def family(rng, vocabulary, n, size, edits):
    base = rng.choices(vocabulary, k=size)
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(size)] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


# Components and the exchange


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 330)] + [(500, x) for x in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(600, [e for e in edges if e[0] is not None])
    assert got == {x: want[x] for e in edges if e[0] is not None and e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packed_runs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False))
        assert (_unpacked_keys(_packed_keys(keys), len(keys)) == keys).all()
        short = np.unique(keys & np.uint64(2**64 - 256))
        assert (_unpacked_keys(_packed_keys(short), len(short)) == short).all() and len(_packed_keys(short)) <= len(_packed_keys(keys))
        for top in (2, 300, 70_000, 2**40):
            counts = rng.integers(0, top, n)
            assert (_unpacked_counts(_packed_counts(counts)) == counts).all()


def test_rows_and_steps_grow_with_the_blocks():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64, endpoint=False))
    sent = {}
    for blocks in (10, 1_000, 100_000, 25_000_000):
        fan = Fan.of(blocks)
        assert fan.width <= 512 and fan.width**fan.levels >= blocks / 2
        rows, nodes = 0, {blocks - 1}
        for level in range(fan.levels):  # follow one block up; every node of a level has about as many keys as a block
            node = max(nodes)
            first = fan.above(level, node)[1] if level else 0
            below, ranges = fan.width ** (fan.levels - level), fan.width**fan.levels
            own = np.sort(((keys >> np.uint64(32)) // np.uint64(max(1, ranges // below)) + np.uint64((first // fan.width) * below * (2**32 // ranges))) << np.uint64(32)) if level else keys
            table = fan.dealt(level, node, [(np.unique(own), np.ones(len(np.unique(own)), np.int64))])
            rows += table.num_rows
            nodes = set(table.column("_node").to_pylist())
            assert len(nodes) == table.num_rows <= fan.width
        sent[blocks] = rows
    assert sent[100_000] <= 3 * 512 and sent[25_000_000] <= 3 * 512  # per block: 50,000 with a run for each range


@pytest.mark.parametrize("width", [2, 3, 512])
def test_exchange_levels(spark, width):
    rows = [(i % 23, i, f"k{i % 37} k{i % 5} k0") for i in range(400)]
    df = spark.createDataFrame(rows, "_block long, _id long, _text string")
    key = lambda w: zlib.crc32(w.encode()) << 32 | 7

    def counted(table):
        found = [Counter(key(w) for t in table.column("_text").to_pylist() for w in t.split()), Counter(key(t) for t in table.column("_text").to_pylist())]
        return [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], np.int64)) for c in found]

    def finish(table, back):
        words, texts = counted(table)
        of = [dict(zip(k.tolist(), b.tolist(), strict=True)) for (k, _), b in zip((words, texts), back, strict=True)]
        return pa.table({"_id": table.column("_id"), "_sum": [sum(of[0][key(w)] for w in t.split()) * 1000 + of[1][key(t)] for t in table.column("_text").to_pylist()]})

    answers = totals(df, 23, counted, width)
    got = {r._id: r._sum for r in finished(df, answers, 2, finish, "_id long, _sum long").collect()}
    words, texts = Counter(w for r in rows for w in r[2].split()), Counter(r[2] for r in rows)
    assert got == {i: sum(words[w] for w in t.split()) * 1000 + texts[t] for _, i, t in rows}
    assert [tuple(r) for r in answers.where("_block < 0").groupBy("_kind").agg(F.sum("_sum"), F.sum("_distinct")).orderBy("_kind").collect()] == [(0, 1200, len(words)), (1, 400, len(texts))]


# Vectors


def test_e8_is_the_nearest_point():
    assert len(neighbours()) == 240 and np.allclose((neighbours() ** 2).sum(1), 2)
    y = np.random.default_rng(0).standard_normal((200, 8)) * 2
    p = e8(y)
    d = ((y - p) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()
    assert all((((y - (p + v)) ** 2).sum(1) >= d - 1e-9).all() for v in neighbours())


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(40):
        c = rng.standard_normal(16)
        vectors += [c + rng.standard_normal(16) * s for s in rng.choice([0.0, 0.05, 0.1, 0.2], rng.integers(1, 12))]
    vectors = [v.astype("f4") for v in vectors]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0]]
    rows = [(i, [float(x) for x in v], i % 3, "c") for i, v in enumerate(vectors)] + [(1000 + i, v, None, "c") for i, v in enumerate(bad)] + [(None, [1.0] * 16, 1, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, _rep string")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    m = np.array(vectors, float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    found, links = sum(got[i].n_links for i in range(len(m))), near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(len(m))) and found >= 0.97 * links
    want = roots(len(m), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    assert np.mean([got[i].component_id == want[i] for i in range(len(m))]) >= 0.97
    assert all((got[1000 + i].n_links, got[1000 + i].component_id, got[1000 + i].kept) == (0, 1000 + i, True) for i in range(len(bad)))
    assert got[None].n_links == 0 and got[None].component_id is None
    assert near_vectors(df.limit(0)).count() == 0


def test_recall_of_the_defaults_at_any_size():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((3_000, 48))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * side  # pairs right at the threshold
    work = []
    for n in (1_000, 100_000, 10_000_000):
        tables, scale = fitted(n, 0.9, 0.97, 4)
        lattice = Lattice(tables, 4, scale, 11)
        x, y = lattice.cells(a), lattice.cells(b)
        met = ((x == y[:, :, :1]) | (y == x[:, :, :1])).any((1, 2))
        assert met.mean() >= 0.95
        work.append(tables)
    assert work == sorted(work) and work[0] < work[-1]


def test_large_cells_are_dealt_into_chunks(spark, monkeypatch):
    import pagemill.llm.lattice as module

    rng = np.random.default_rng(1)
    c = rng.standard_normal(8)
    rows = [(i, [float(x) for x in c + rng.standard_normal(8) * 0.01]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(module, "CHUNK", 16)
    assert {(r.n_links, r.component_id) for r in near_vectors(df).collect()} == {(89, 0)}


def test_hot_cells_in_bounded_memory():
    rng = np.random.default_rng(2)
    lattice = Lattice(4, 2, 1.1, 11)
    vectors = rng.standard_normal(16) + rng.standard_normal((900, 16)) * 0.002
    homes = lattice.cells(_units(pa.array(vectors.tolist())))[:, :, 0]
    n, tables = homes.shape
    at, zero = np.repeat(np.arange(n), tables), pa.array(np.zeros(n * tables, np.int32))
    columns = {"_cell": pa.array(homes.reshape(-1).view(np.int64)), "_home": pa.array(np.ones(n * tables, bool)), "_rep": pa.array(at), "_own": zero, "_i": zero, "_j": zero, "_v": pa.array(vectors.tolist()).take(pa.array(at)), "_n": pa.array(np.ones(n * tables, np.int64))}
    table = pa.table(columns)
    tracemalloc.start()
    found = _verified(table, lattice, 0.9).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    together = (homes[:, None] == homes[None]).any(2)
    np.fill_diagonal(together, False)
    assert {r["_a"]: r["_b"] for r in found if not r["_edge"]} == {i: k for i, k in enumerate(together.sum(1).tolist()) if k}
    assert {r["_a"]: r["_b"] for r in found if r["_edge"]} == {i: k for i, k in enumerate(roots(n, np.argwhere(together).tolist())) if k != i}
    assert together.sum() > n * n // 2 and peak < 30 << 20


# Language model


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_score(spark, order, monkeypatch):
    import pagemill.llm.lm_score as module

    monkeypatch.setattr(module, "LANE", 7)
    rng = random.Random(order)
    words = ["the", "The", "of", "é", "x.", "É", "rare"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)] + [None, "", "\x0b\x1c a", "never seen words"]
    ids = [*range(len(texts) - 1), 3]
    got = lm_score(docs(spark, texts, ids), F.col("doc_id") % 3 != 0, order=order, block_bytes=1 << 10).collect()
    tokens = [["<s>", *TOKEN.findall((t or "").translate(LOW)), "</s>"] for t in texts]
    learn = [i % 3 != 0 for i in ids]
    count, m = Counter(), 8.0
    for t, use in zip(tokens, learn, strict=True):
        for k in range(1, order + 1):
            count.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1) if use)
    unigrams = {g[0]: n for g, n in count.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(unigrams.values()), len(unigrams)

    def p(h, w):
        low = (unigrams.get(w, 0) + 0.5) / (n + 0.5 * (v + 1)) if not h else p(h[1:], w)
        return low if not h else (count[(*h, w)] + m * low) / (count[h] + m)

    want = []
    for i, t in zip(ids, tokens, strict=True):
        base = sum(math.log10((unigrams.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t[1:])
        score = sum(math.log10(p(tuple(t[max(0, j - order + 1) : j]), w)) for j, w in enumerate(t) if j)
        want.append((i, len(t) - 1, sum(w in unigrams for w in t[1:]), n, pytest.approx(base), pytest.approx(score)))
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key) == sorted(want, key=key)
    assert lm_score(docs(spark, []), F.lit(True)).count() == 0
    assert {r.score for r in lm_score(docs(spark, ["a b", None]), F.lit(False)).collect()} == {0.0}


# N-gram join


def jaccard_roots(sets, percent=90):
    n = len(sets)
    return roots(n, [(a, b) for a in range(n) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])


def test_similar_texts(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [t for _ in range(12) for t in family(rng, vocabulary, rng.randint(1, 14), rng.choice([4, 25, 60, 200]), 5)]
    texts += ["", None, "one", "ONE", "one two", "a b c", "a b  c", " \t", "é É b"] + [" ".join(vocabulary[:150])] * 3
    got = {r.doc_id: r for r in similar_texts(docs(spark, texts), block_bytes=1 << 12).collect()}
    words = [TOKEN.findall((t or "").translate(LOW)) for t in texts]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()) for w in words]
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == jaccard_roots(sets)
    assert similar_texts(docs(spark, [])).count() == 0
    other, near = " ".join(vocabulary[:60]), " ".join(vocabulary[100:160])
    shared = similar_texts(docs(spark, [other, near, near + " more", other + " less", near], [5, 5, 7, 9, 5])).collect()
    assert sorted((r.doc_id, r.component_id) for r in shared) == [(5, 5), (5, 5), (5, 5), (7, 5), (9, 5)]
    assert sorted(str(r.component_id) for r in similar_texts(docs(spark, ["a b c"] * 3, [5, 4, None])).collect()) == ["4", "4", "None"]


def test_large_groups_are_dealt_into_chunks(spark, monkeypatch):
    import pagemill.llm.ngram_join as module

    rng = random.Random(8)
    texts = family(rng, [f"w{i}" for i in range(500)], 60, 80, 3)
    monkeypatch.setattr(module, "CHUNK", 300)
    got = {r.doc_id: r.component_id for r in similar_texts(docs(spark, texts)).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    assert [got[i] for i in range(60)] == jaccard_roots(sets)


def test_many_small_sets_are_dealt_into_chunks(spark, monkeypatch):
    import pagemill.llm.ngram_join as module

    # One token ties 5,000 sets of 12 shingles: far from the bound on shingles.
    shared = np.array([7], np.int64).tobytes()
    members = spark.range(5_000).select(F.col("id").alias("_rep"), F.lit(12).cast("long").alias("_n"), F.lit(20).alias("_class"), F.lit(shared).alias("_prefix"))
    sizes = [r["count"] for r in module._placed(members, "bigint").groupBy("_group", "_task").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * module.SETS
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = [t for _ in range(3) for t in family(rng, words, 60, 40, 2)]
    monkeypatch.setattr(module, "SETS", 16)
    monkeypatch.setattr(module, "BATCH", 20_000)
    want = jaccard_roots([set(shingle_sets([t.encode()], 3)[0].tolist()) for t in texts])
    assert len(set(want)) < len(want)
    assert [r.component_id for r in sorted(similar_texts(docs(spark, texts)).collect(), key=lambda r: r.doc_id)] == want


def test_sets_too_small_to_link_with_others(spark):
    # 50,000 texts of one template, 7 shingles each; among them equal ones.
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.format_string("the order number %d was sent to you today", F.col("id") % 49_990).alias("text"))
    got = similar_texts(rows)
    assert got.where((F.col("n_shingles") != 7) | (F.col("component_id") != F.col("doc_id") % 49_990)).count() == 0
    # Nine shingles against the same nine and one more are the least that link.
    nine = "a b c d e f g h i j k"
    assert [r.component_id for r in similar_texts(docs(spark, [nine, nine + " l", nine[:-2], nine[:-2]])).orderBy("doc_id").collect()] == [0, 0, 2, 2]


def test_overlap_rows_are_released():
    rng = np.random.default_rng(3)
    families = [np.unique(rng.integers(0, 2**63, 40).astype(np.uint64)) for _ in range(300)]
    sets = [np.unique(np.r_[f[1:], rng.integers(0, 2**63, 1).astype(np.uint64)]) for f in families for _ in range(10)]
    tracemalloc.start()
    forest = spanning_links(sets, 90)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(forest) == 2700 and peak < 2 * len(sets) ** 2


def test_small_sets_in_one_group_stay_within_memory():
    sets = [np.array([i, 2**40 + i % 16_000], np.uint64) for i in range(20_000)]
    tracemalloc.start()
    forest = spanning_links(sets, 90)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert forest == [] and peak < 64 << 20  # a matrix of overlaps would take 1.6 GB
    hot = [np.array([2**41, i], np.uint64) for i in range(3_000)] + [np.array([2**41, 1], np.uint64)]  # one token in every list
    assert spanning_links(hot, 90) == [(1, 3_000)]


def test_only_blocks_of_positions_are_read():
    # A token that all sets hold, sizes from 10 to 409: a set's block holds the next tenth of sizes only.
    rng = np.random.default_rng(5)
    sets = [np.unique(np.r_[np.uint64(7), rng.integers(8, 2**63, n - 1).astype(np.uint64)]) for n in range(10, 410)]
    lists = []
    assert spanning_links(sets, 90, lists) == []
    assert 0 < lists[0].read <= sum(min(n * 100 // 90, 409) - n for n in range(10, 410)) < len(sets) ** 2 / 16
    # Near copies: all but the first derive their answers, from lists of the few tokens that differ.
    base = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    near = [np.unique(np.r_[np.delete(base, i), np.uint64(i)]) for i in range(200)]
    assert len(spanning_links(near, 90, lists)) == 199
    assert lists[1].read < 5 * 200 * 400 < 200 * 200 * 400 / 2


def test_skipping_loses_no_link(monkeypatch):
    import pagemill.llm.ngram_join as module

    rng = random.Random(7)
    for _ in range(30):
        texts = [t for _ in range(3) for t in family(rng, [f"w{i}" for i in range(50)], 8, rng.choice([5, 40]), 4)]
        sets = shingle_sets([t.encode() for t in texts], 3)
        monkeypatch.setattr(module, "ROWS", rng.choice([0, 200, 1 << 20]))
        forest = spanning_links(sets, 80)
        assert roots(len(sets), forest) == jaccard_roots([set(s.tolist()) for s in sets], 80)


# Suffixes and repeated strings


def test_suffix_arrays():
    rng = random.Random(0)
    for _ in range(200):
        k = rng.choice([1, 2, 4, 26])
        s = bytes(rng.randrange(97, 97 + k) for _ in range(rng.randrange(300)))
        s = rng.choice([s, s * 2, s + b"x" + s])
        depth, data = rng.choice([8, 16, 40, 200]), np.frombuffer(s, np.uint8)
        order = suffix_array(data, depth)
        assert sorted(order.tolist()) == list(range(len(s)))
        cut = [s[i : i + depth] for i in order]
        assert cut == sorted(cut)
        for (a, b), n in zip(zip(order, order[1:], strict=False), adjacent_prefixes(data, order, depth)[1:], strict=True):
            assert n == next((i for i in range(depth) if i + max(a, b) >= len(s) or s[a + i] != s[b + i]), depth)


@pytest.mark.parametrize("group_bytes", [1, 1 << 20])
def test_remove_repeats(spark, group_bytes):
    rng = random.Random(group_bytes)
    make = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    passages = [make(rng.randint(30, 120)) for _ in range(6)]
    texts = [make(rng.randint(0, 60)) + rng.choice(passages) + make(rng.randint(0, 60)) + rng.choice(passages + [""]) for _ in range(70)]
    texts += [None, "", "a" * 400, "ab" * 100, texts[0], texts[0], passages[0]]
    ids = [*range(len(texts) - 1), 2]
    length = 40
    rows = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in rows for i in range(len(b) - length + 1))
    want = []
    for i, b in zip(ids, rows, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = remove_repeats(docs(spark, texts, ids), length=length, digest=True, group_bytes=group_bytes, block_bytes=1 << 11).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    full = remove_repeats(docs(spark, texts, ids), length=length, group_bytes=group_bytes).collect()
    assert sorted(hashlib.sha256(r.kept).hexdigest() for r in full) == sorted(w[4] for w in want)
    assert remove_repeats(docs(spark, []), length=length).count() == 0


@pytest.mark.parametrize("group_bytes", [3_000, 1 << 20])
def test_very_frequent_anchors(spark, group_bytes):
    # 600 texts share a passage shorter than a string, amid bytes of their own; some of these are shared by a few.
    rng = random.Random(5)
    make = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    passage, sides = make(36), [make(12) for _ in range(40)]
    texts = [rng.choice([make(12), rng.choice(sides)]) + passage + rng.choice([make(12), rng.choice(sides)]) for _ in range(600)]
    length = 40
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = {i: sum(any(count[t[k : k + length]] > 1 for k in range(max(0, j - length + 1), min(j, len(t) - length) + 1)) for j in range(len(t))) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs(spark, texts), length=length, digest=True, group_bytes=group_bytes).collect()} == want


# Pipeline


def test_pipeline_against_plain_python(spark, tiny):
    import corpus_pipeline

    rows = spark.read.parquet(f"{tiny}/documents.parquet").toPandas()
    stages = dict(corpus_pipeline.STAGES)
    texts = dict(zip(rows.doc_id, rows.text, strict=True))
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = stages["language_id"](spark, docs, tiny)
    assert kept.columns == docs.columns and kept.count() == sum(bool(re.search(r"[^\W\d_]", t or "")) for t in texts.values())
    best = {}
    for i, t in texts.items():
        best[t] = max(i, best.get(t, -1))
    exact = stages["exact_dedup"](spark, kept, tiny)
    assert {r.doc_id for r in exact.collect()} == set(best.values()) and exact.columns == docs.columns
    near = stages["ngram_jaccard_join"](spark, exact, tiny)
    order = sorted(best.values())
    words = [TOKEN.findall(texts[i].translate(LOW)) for i in order]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} or {tuple(w)} for w in words]
    stay = {order[r] for r in jaccard_roots(sets)}
    assert {r.doc_id for r in near.collect()} == stay
    clean = stages["secret_scan"](spark, near, tiny)
    assert {r.doc_id for r in clean.collect()} == stay
    assert not any(re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text) for r in clean.collect()) and all(r.n_chars == len(r.text) for r in clean.collect())
    packed = corpus_pipeline.run(spark, tiny)
    assert {r.doc_id for r in packed.collect()} == stay


@pytest.mark.parametrize("texts", [[], [None, None], ["12 !", ""]])
def test_pipeline_of_nothing(spark, tmp_path, texts):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_with_odd_columns(spark):
    """Columns named as the stages name theirs, and no n_chars."""
    import corpus_pipeline

    rows = [(i, "The quick brown fox jumps over the lazy dog and runs away " * 3 + str(i % 3), "en", "k", "r", 1) for i in range(12)] + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _kept string, _row string, _bucket int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "_kept", "_row", "_bucket"], name
    assert dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, "").count() == docs.count() > 0


def test_pack_takes_any_name_of_an_id(spark):
    from pagemill.llm.packing import pack

    for name in ("_bucket", "_rank", "_n", "_at", "_before"):
        pieces = spark.createDataFrame([(i, 0, 0, 1000 + i, 7) for i in range(40)], f"{name} long, piece int, start long, length long, ids_crc32 long")
        got = pack(pieces, id_col=name)
        assert got.columns[0] == name and {r[0] for r in got.collect()} == set(range(40))
