"""Documents cut at safe gaps: folds per piece equal the folds over whole documents."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.functions import script as S
from pagemill.operators import fusion
from pagemill.plans import registry

WORDS = ["alpha", "alphas", "beta", "x", "gamma", "delta", "a-b", "Ünï"]


def layout(seed, n=160, tall=0.05):
    """Words over many heights, some of them tall enough to reach over several lines, with gaps between blocks."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        h = rng.uniform(60, 200) if rng.random() < tall else rng.uniform(6, 20)
        y = rng.randrange(12) * 90 + rng.choice([0, 2, 9, 31])
        out.append({"doc_id": 1, "word_id": f"w{i:03}", "word_index": i, "branch_index": rng.randrange(3), "norm_text": rng.choice(WORDS), "text": "t", "x": rng.uniform(0, 200), "y": float(y), "w": rng.uniform(4, 60), "h": h, "confidence": float(rng.randrange(50, 99)), "candidate": rng.randrange(2), "line_index": 0})
    frame = pd.DataFrame(out)
    return frame.assign(candidate_score=90.0 - frame["candidate"])


@pytest.mark.parametrize("rule", [fusion.FUSION, fusion.COVERAGE])
def test_pairs_are_all_pairs(rule):
    for seed in range(8):
        pdf = layout(seed)
        boxes, folds = pdf[["x", "y", "w", "h"]].to_numpy(), [fusion._fold(t) for t in pdf["norm_text"]]
        want = {(j, i): rule.of(boxes[i], boxes[j], folds[i], folds[j]) for j in range(len(pdf)) for i in range(j)}
        got = dict(zip(zip(*(c.tolist() for c in rule.pairs(boxes, folds)[:2]), strict=True), rule.pairs(boxes, folds)[2].tolist(), strict=True))
        assert got == pytest.approx({k: o for k, o in want.items() if o > 0})
    odd = np.array([[np.nan, 0, 5, 5], [0, 0, 5, 5], [0, 0, 5, 5]], float)
    assert [c.tolist() for c in rule.pairs(odd, ["A", "A", "A"])] == [[2], [1], [1.0]]


def slow_lines(boxes):
    tops, bottoms, member = [], [], [-1] * len(boxes)
    for k in np.lexsort((boxes[:, 0], boxes[:, 1])).tolist():
        y, h = boxes[k, 1], boxes[k, 3]
        fit = next((i for i in range(len(tops)) if min(bottoms[i], y + h) - max(tops[i], y) >= fusion.LINE_OVERLAP * max(min(bottoms[i] - tops[i], h), 1e-9)), None)
        if fit is None:
            fit = len(tops)
            tops.append(y)
            bottoms.append(y + h)
        bottoms[fit] = max(bottoms[fit], y + h)
        member[k] = fit
    order = sorted(range(len(tops)), key=lambda i: (tops[i], i))
    return [order.index(i) for i in member]


def test_lines_by_sweep():
    for seed in range(20):
        boxes = layout(seed, tall=0.2)[["x", "y", "w", "h"]].to_numpy()
        assert fusion.built_lines(boxes).tolist() == slow_lines(boxes)
    many = np.array([[0.0, 24.0 * i, 10.0, 18.0] for i in range(20_000)])
    began = time.perf_counter()
    assert fusion.built_lines(many).tolist() == list(range(20_000)) and time.perf_counter() - began < 1


def slow_coverage(pdf):
    rows = pdf.sort_values(["candidate_score", "candidate", "word_index", "word_id"], ascending=[False, True, True, True], kind="stable").to_dict("records")
    kept = []
    for r in rows:
        box, fold = [r[c] for c in "xywh"], fusion._fold(r["norm_text"])
        hit = next((p for p, k in enumerate(kept) if fusion.COVERAGE.of(box, [k[c] for c in "xywh"], fold, fusion._fold(k["norm_text"])) > 0), None)
        if hit is None:
            kept.append(r)
        elif r["_score"] > kept[hit]["_score"]:
            kept[hit] = r
    return [r["word_id"] for r in kept]


def test_coverage_by_pairs():
    for seed in range(12):
        pdf = layout(seed).assign(_score=lambda d: d["confidence"] // 10)
        ordered = pdf.sort_values(["candidate_score", "candidate", "word_index", "word_id"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        assert ordered.iloc[fusion.coverage_places(ordered)]["word_id"].tolist() == slow_coverage(pdf)


COLUMNS = ["doc_id", "word_id", "word_index", "line_index", "text", "norm_text", "x", "y", "w", "h", "confidence"]


def test_cuts_change_nothing(spark):
    rows = pd.concat([layout(s).assign(doc_id=s) for s in range(6)], ignore_index=True)
    words = spark.createDataFrame(rows)
    cut = fusion.in_pieces(words, 1).select("doc_id", "_piece").distinct().count()
    assert cut > 12  # several pieces a document
    branches = [(name, words.where(f"branch_index = {i}").select(*COLUMNS)) for i, name in enumerate(["English", "Russian", "English"])]
    for fold in (lambda n: fusion.fused(branches, n), lambda n: fusion.coverage_merged(words.select(*COLUMNS, "candidate", "candidate_score"), n)):
        one, many = (sorted(map(str, fold(n).select(*COLUMNS).collect())) for n in (10**9, 1))
        assert one == many and len(one) > 100


def relined(rows):
    lines = slow_lines(np.array([[r[c] for c in "xywh"] for r in rows], float))
    order = sorted(range(len(rows)), key=lambda i: (lines[i], rows[i]["x"], rows[i]["y"], rows[i]["word_id"]))
    return [(rows[i]["word_id"], k, lines[i]) for k, i in enumerate(order)]


def slow_fusion(rows):
    groups = []
    for r in sorted(rows, key=lambda r: (r["y"], r["x"], r["branch_index"], r["word_index"], r["word_id"])):
        r["_box"], r["_fold"], best, at = [r[c] for c in "xywh"], fusion._fold(r["norm_text"]), 0.0, None
        for g in groups:
            o = max(fusion.FUSION.of(r["_box"], m["_box"], r["_fold"], m["_fold"]) for m in g)
            if o > best:
                best, at = o, g
        if at is None:
            groups.append([r])
        else:
            at.append(r)
    best = []
    for g in groups:
        cyrillic, protected = max(m["_c"] for m in g), max(m["_p"] for m in g)
        score = lambda m: m["_score"] + float(fusion.group_preference(cyrillic, protected, m["_c"], m["_p"]))  # noqa: B023, E731
        best.append(min(g, key=lambda m: (-score(m), m["branch_index"], m["word_index"], m["word_id"])))
    return relined(best)


def test_registered_queries_against_loops(spark, tiny):
    """fused_words and coverage_merge: every text of 3 to 90 words by plain loops over all its words."""
    w = registry.words(spark, tiny)
    short = w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 3 AND 90").select("doc_id")
    first, second, third = (d.join(short, "doc_id") for d in (w, registry.jittered(w, 1), registry.jittered(w, 2)))
    t = F.col("norm_text")
    both = fusion.united([("English", first), ("Russian", second)])
    both = both.withColumns({"_score": fusion.word_preference(both).cast("double"), "_c": t.rlike(S.CYRILLIC).cast("int"), "_p": S.is_protected(t, codes=False).cast("int")}).toPandas()
    merged = second.withColumns({"candidate": F.lit(0), "candidate_score": F.lit(80.0)}).unionByName(third.withColumns({"candidate": F.lit(1), "candidate_score": F.lit(70.0)}))
    merged = merged.withColumn("_score", fusion.coverage_preference(t, F.col("confidence")).cast("double")).toPandas()
    for name, rows, fold in (("fused_words", both, lambda d: slow_fusion(d.to_dict("records"))), ("coverage_merge", merged, lambda d: relined(d.set_index("word_id", drop=False).loc[slow_coverage(d)].to_dict("records")))):
        got = registry.QUERIES[name](spark, tiny).toPandas()
        per_doc = {d: sorted(zip(g["word_id"], g["word_index"], g["line_index"], strict=True)) for d, g in got.groupby("doc_id")}
        assert len(per_doc) == w.select("doc_id").distinct().count()
        docs = dict(tuple(rows.groupby("doc_id")))
        assert len(docs) > 20
        for doc, pdf in docs.items():
            assert per_doc[doc] == sorted(fold(pdf)), (name, doc)
