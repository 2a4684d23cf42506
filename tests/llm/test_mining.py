"""Phrases, centroids and toxicity against brute force, with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import toxicity as T
from pagemill.llm.centroids import Centroids, centroid_clusters, floored, searched, wide_nearest
from pagemill.llm.common import mix64
from pagemill.llm.phrases import collocations, unmixed
from pagemill.llm.toxicity import Lexicon, dependencies, findings, label_model, logistic, toxicity

CLASH = "doc_id long, text string, lang string, _id string, _text string, _lang string, _block int, _y int, score double, phrase string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, x, "c", "c", "c", 1, 1, 2.0, "p") for i, t, x in rows], CLASH)


# Phrases


def plain_collocations(rows, longest, least, top, contained):
    counts = {}
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault("und" if lang is None else lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            held = (n for q, n in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * n >= contained * a for n in held):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((" ".join(p), a, f[p[:k]], f[p[k:]], score))
        found.sort(key=lambda x: (-x[4], -x[1], x[0].encode()))
        n = sum(v for p, v in f.items() if len(p) == 1)
        out += [(lang, i, p, a, left, right, n, score) for i, (p, a, left, right, score) in enumerate(found[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_match_counting(spark, longest):
    rng = random.Random(longest)
    vocabulary = ["a", "b", "New", "YORK", "ünï", "😀", "é́", "x_y", "d"]
    rows = [(i % 7, "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ", ", ". ", "\n", "\r\n", "\x0b", " - "]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, "und", ""])) for i in range(60)]
    rows += [(None, "new york a b", "en")] * 12 + [(1, None, "en"), (2, "", None), (3, " \t\n.,", "xx"), (4, "a " * 3000, "long")]
    got = [tuple(r) for r in collocations(docs(spark, rows), longest=longest, least=4, top=9).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == plain_collocations(rows, longest, 4, 9, 50) and len(got) > 20


def test_collocations_of_nothing(spark):
    assert collocations(docs(spark, [])).count() == 0
    assert collocations(docs(spark, [(1, None, None), (2, "one two", "en")])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    from pagemill.llm.phrases import CUT_SCORE

    rng = random.Random(1)
    cases = [(n, n + rng.randrange(10), n + rng.randrange(10**15)) for n in (10, 10**9 + 7, 10**13 + 9, 9 * 10**15)]
    rows = spark.createDataFrame([(a, {"_begins": x, "_ends": y}) for a, x, y in cases], "_n long, c struct<_begins:long,_ends:long>")
    assert [r[0] for r in rows.select(F.expr(CUT_SCORE)).collect()] == [1_000_000 * a * a // (x * y) for a, x, y in cases]
    keys = np.array([rng.getrandbits(64) for _ in range(1000)] + [0, 2**64 - 1], np.uint64)
    assert (unmixed(mix64(keys)) == keys).all()


# Centroids


def plain_clusters(rows, k, rounds, size=64, scale=64):
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**53 else math.floor(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda c: (distance(v, centroids[c]), c))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        centroids = [[sum(x) // len(own) for x in zip(*own, strict=True)] if (own := [v for (_, v), a in zip(kept, at, strict=True) if a == c]) else centroids[c] for c in range(len(centroids))]
    told = [(i, c := near(v), distance(v, centroids[c])) for i, v in kept]
    sums = Counter()
    for _, c, d in told:
        sums[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums.values()), sha[c]) for i, c, d in told), key=str)


VECTORS = "vec_id long, embedding array<{}>, _id string, _v int, cluster string"


@pytest.mark.parametrize("element", ["float", "double"])
def test_clusters_match_plain_rounds(spark, element):
    rng = random.Random(3)
    near = lambda c: [float(np.float32(c + rng.choice([-0.25, 0, 0.25, rng.gauss(0, 0.1)]))) for _ in range(64)]
    rows = [(i, near(rng.choice([-1.0, 0.0, 0.5, 2.0]))) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, near(0.0)), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [float("nan")] + [0.0] * 63), (505, [float("inf")] * 64), (506, [None] + [0.0] * 63), (507, [0.0] * 64), (508, [-0.0] * 64)]
    table = spark.createDataFrame([(i, v, "c", 1, "c") for i, v in rows], VECTORS.format(element))
    for k, rounds in ((16, 3), (5, 0), (1, 2), (400, 1)):
        got = sorted((tuple(r) for r in centroid_clusters(table, k=k, rounds=rounds).collect()), key=str)
        assert got == plain_clusters(rows, k, rounds)


def test_ties_and_wide_components(spark):
    base = [[float(i % 3)] + [0.0] * 63 for i in range(30)]  # many at equal distances from several centroids
    wide = [[1e30 if i == 0 else 3e7] * 64 for i in range(3)] + [[-70000.5] * 64]
    for vectors in (base, base + wide):
        rows = list(enumerate(vectors))
        table = spark.createDataFrame([(i, v, "c", 1, "c") for i, v in rows], VECTORS.format("double"))
        want = [(i, c, d if d < 2**63 else None, n if n < 2**63 else None, t if t < 2**63 else None, h) for i, c, d, n, t, h in plain_clusters(rows, 6, 3)]
        got = sorted((tuple(r) for r in centroid_clusters(table, k=6).collect()), key=str)
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want, key=str)] and {g[5] for g in got} == {w[5] for w in want}
        if vectors is base:
            assert got == sorted(want, key=str)
    assert centroid_clusters(table.where("false")).count() == 0
    assert floored([0.01, -0.01, 2.0**60], 64) == [0, -1, 2**66]


def test_search_is_exact_and_measures_less():
    rng = np.random.default_rng(0)
    means = rng.integers(-400, 400, (40, 8))
    x = (means[rng.integers(0, 40, 4000)] + rng.integers(-12, 12, (4000, 8))).astype(float)
    own, up, low, total = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x)), []
    at, before = [list(map(int, v)) for v in x[:40]], None
    for _ in range(6):
        c = Centroids(at, before)
        up, low = up + c.moved[np.maximum(own, 0)] * (1 + 1e-12), np.maximum(low - c.moved.max(), 0)
        own, up, low, measured = searched(x, own, up, low, c)
        want = wide_nearest([list(map(int, v)) for v in x[:300]], c)
        assert own[:300].tolist() == [w[0] for w in want]
        exact = np.sqrt([w[1] for w in want])
        assert (up[:300] >= exact).all() and (low[:300] <= np.sqrt([w[2] for w in want]) + 1e-9).all()
        total.append(measured)
        before, at = c, [[int(s) // max(int((own == k).sum()), 1) for s in x[own == k].sum(0)] if (own == k).any() else c.at[k] for k in range(40)]
    assert total[-1] < 0.2 * 40 * len(x)


# Toxicity


def test_findings():
    lexicon = Lexicon(["idiot"], ["lowe", "lowei"])
    at = lambda text: dict(zip(["idiot", "lowe", "lowei", *T.PATTERNS], findings(text, lexicon).tolist(), strict=True))
    assert at("You IDIOT, loweisch!")["idiot"] == 1 and at("loweisch")["lowei"] == at("loweisch")["lowe"] == 1
    assert at("YOU IDIOT")["shouted"] == 1 and at("you idiot")["addressed"] == 1 and at("idiots")["idiot"] == 0
    assert at("1d10t")["swapped"] == 1 and at("i-d-i-o-t")["spaced"] == 1 and at("2024 100")["swapped"] == 0
    assert at("")["silent"] == 1 and at("idiot")["silent"] == 0 and at("Nice!!!")["exclaimed"] == 1
    assert findings("a." * 50_000 + "x" * 70_000 + "1" * 70_000, lexicon).sum() >= 0


def test_label_model_finds_accuracies_and_correlations():
    """Votes drawn from a known model: labels of a few, accuracies of each voter, and the two that copy each other."""
    rng = np.random.default_rng(1)
    n, y = 6000, None
    y = (rng.random(n) < 0.3).astype(int)
    fires = lambda a, b: rng.random(n) < np.where(y == 1, a, b)
    first = fires(0.6, 0.02)
    columns = [first, first ^ (rng.random(n) < 0.01), fires(0.5, 0.01), fires(0.4, 0.1)]
    v = np.stack([np.where(c, T.TOXIC, T.ABSTAINS) for c in columns], 1)
    known = np.where(rng.random(n) < 0.2, y, -1)
    model, q = label_model(v, known, np.where(np.any(columns, 0), 0.8, 0.05), np.ones(n))
    hidden = known < 0
    chance = lambda rates: np.prod([np.where(c, r, 1 - r) for c, r in zip((columns[0], *columns[2:]), rates, strict=True)], axis=0)
    best = 0.3 * chance((0.6, 0.5, 0.4)) > 0.7 * chance((0.02, 0.01, 0.1))  # what who knows all rates would say
    assert ((q > 0.5) == y)[hidden].mean() > (best == y)[hidden].mean() - 0.06 and abs(model.prior[1] - 0.3) < 0.08
    right = [y[c].mean() for c in columns]
    assert model.accuracies(v)[:4] == pytest.approx(right, abs=0.08)
    assert model.parents[1] == 0 or model.parents[0] == 1
    assert dependencies(v[:, 2:4], np.stack([1.0 - y, y]), 0.02) == [-1, -1]


def test_logistic_matches_its_gradient():
    rng = np.random.default_rng(2)
    x, weights = rng.random((300, 3)), rng.random(300)
    q = 1 / (1 + np.exp(-(x @ [3.0, -2.0, 0.5] - 1)))
    w = logistic(x, q, weights, np.zeros(4), penalty=1e-6)
    p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
    assert np.abs((weights * (p - q)) @ x).max() < 0.05


def corpus(rng, n):
    good = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(good, k=rng.randint(5, 60))
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorkel", "Zorkels", "zorkelig", "idiot"]))
        rows.append((i, " ".join(words), "en"))
        if rng.random() < 0.7:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_words_and_spares_clean_texts(spark):
    rng = random.Random(9)
    rows, labels = corpus(rng, 900)
    truth = {i: any("zorkel" in w.lower() or w == "idiot" for w in t.split()) for i, t, _ in rows}
    rows += [(900, None, None), (901, "", None), (902, "x" * 70_000, None), (None, "you idiot", None), (5, "again", None)]
    labels += [(1, 1), (1, 0), (900, None), (901, 7), (None, 1), (10**6, 1)]
    table = spark.createDataFrame([(i, y, "c", 1) for i, y in labels], "doc_id long, toxic int, _id string, _y int")
    held = lambda c: F.crc32(F.col(c).cast("string")) % 3 == 1
    out = toxicity(docs(spark, rows), table, lambda c: ~F.coalesce(held(c), F.lit(False)))
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    wrong = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id != 5 and r.predicted != truth[r.doc_id]]
    assert not wrong
    assert [r.predicted for r in got if r.doc_id is None] == [1] and {r.predicted for r in got if r.doc_id in (900, 901, 902)} == {0}
    assert {r.doc_id: r.score for r in out.collect() if r.doc_id} == {r.doc_id: r.score for r in got if r.doc_id}


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    learn = lambda c: F.lit(True)
    assert toxicity(docs(spark, []), none, learn).count() == 0
    got = {r.doc_id: r.score for r in toxicity(docs(spark, [(1, "you idiot moron", "en"), (2, "a fine day", "en"), (3, None, None)]), none, learn).collect()}
    assert got[1] > got[2] and all(0 <= s <= 1 for s in got.values())


def test_held_out_accuracy(spark):
    """op13 on the smallest table with enough labels: held-out English documents."""
    from pagemill.llm import registry

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = registry.QUERIES["op13_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    assert len(rows) > 80 and np.mean([r.predicted == r.toxic for r in rows]) > 0.93
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 1
