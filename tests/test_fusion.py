"""Fusion against loops written without grids, and independence of row order."""

import random

import numpy as np
import pandas as pd

from pagemill.operators import fusion
from pagemill.sources.layout import jittered, synthetic_words


def frame(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "alphas", "beta", "x", "gamma", "delta"]
    return pd.DataFrame([{"doc_id": 1, "word_id": f"w{i}", "word_index": i, "branch_index": rng.randrange(2), "norm_text": rng.choice(words), "text": "", "x": float(rng.randrange(300)), "y": float(rng.randrange(120)), "w": float(rng.randrange(5, 60)), "h": float(rng.randrange(8, 20)), "confidence": 1.0} for i in range(n)])


def plain_groups(pdf):
    rows = sorted(pdf.to_dict("records"), key=lambda r: (r["y"], r["x"], r["branch_index"], r["word_index"]))
    groups = []
    for r in rows:
        box, fold = [r[c] for c in "xywh"], r["norm_text"].upper()
        best, at = 0.0, None
        for g in groups:
            o = max(fusion.same_visible_word(box, [m[c] for c in "xywh"], fold, m["norm_text"].upper()) for m in g)
            if o > best:
                best, at = o, g
        if at is None:
            groups.append([r])
        else:
            at.append(r)
    return sorted(sorted(m["word_id"] for m in g) for g in groups)


def test_groups_match_a_plain_loop():
    for seed in range(12):
        pdf = frame(60, seed)
        got = pdf.assign(g=fusion.grouped_words(pdf)).groupby("g")["word_id"].apply(sorted).tolist()
        assert sorted(got) == plain_groups(pdf)


def test_lines_grow_and_are_numbered_from_the_top():
    boxes = np.array([[50, 1, 10, 10], [0, 0, 10, 10], [0, 30, 10, 10], [20, 3, 10, 10]], float)
    assert fusion.built_lines(boxes).tolist() == [0, 0, 1, 0]
    assert fusion.built_lines(np.zeros((0, 4))).tolist() == []


def test_fusing_ignores_row_order_and_takes_one_of_each(spark):
    docs = spark.createDataFrame([(i, "some words that stand here\nand a second line of them") for i in range(3)], "doc_id long, text string")
    words = synthetic_words(docs, step=160)
    out = []
    for shuffle in (False, True):
        a, b = words, jittered(words, 1)
        if shuffle:
            a, b = a.orderBy("word_id", ascending=False), b.orderBy("text")
        out.append(sorted(map(tuple, fusion.fused([("English", a), ("Russian", b)]).select("doc_id", "line_index", "word_index", "norm_text").collect())))
    assert out[0] == out[1]
    assert len(out[0]) == words.count()


def test_coverage_adds_what_is_missing(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    words = synthetic_words(docs, step=160)
    first = words.where("text <> 'two'").selectExpr("*", "0 AS candidate", "90D AS candidate_score")
    second = words.selectExpr("*", "1 AS candidate", "80D AS candidate_score").withColumn("word_id", fusion.F.concat(fusion.F.lit("s"), "word_id"))
    assert [r.norm_text for r in fusion.coverage_merged(first.unionByName(second)).orderBy("word_index").collect()] == ["one", "two", "three"]


def test_overlap_join_matches_all_pairs(spark):
    rows = frame(82, 3)
    rows.loc[80:, ["word_id", "branch_index", "norm_text", "x", "y", "w", "h"]] = [["near0", 0, "alpha", 1021.0, 0.0, 5.0, 20.0], ["near1", 1, "alpha", 1027.0, 0.0, 5.0, 20.0]]  # only their centres are near, in cells of their own
    left, right = rows[rows.branch_index == 0], rows[rows.branch_index == 1]
    want = set()
    for a in left.to_dict("records"):
        for b in right.to_dict("records"):
            o = fusion.same_visible_word([a[c] for c in "xywh"], [b[c] for c in "xywh"], a["norm_text"].upper(), b["norm_text"].upper())
            if o > 0:
                want.add((a["word_id"], b["word_id"]))
    assert ("near0", "near1") in want
    found = fusion.overlapping(spark.createDataFrame(left), spark.createDataFrame(right)).collect()
    assert len(found) == len(want) and {(r.left_id, r.right_id) for r in found} == want


def test_group_flags_decide_between_scripts(spark):
    columns = "doc_id long, word_id string, word_index long, line_index int, text string, norm_text string, x double, y double, w double, h double, confidence double"
    word = lambda i, t, c: (1, f"w{i}", i, 0, t, t, 100.0 * i, 0.0, 60.0, 18.0, c)
    english = spark.createDataFrame([word(0, "COBET", 84.0), word(1, "a.exe", 80.0), word(2, "plain", 90.0)], columns)
    russian = spark.createDataFrame([word(0, "СОВЕТ", 80.0), word(1, "а.ехе", 85.0), word(2, "plein", 88.0)], columns)
    got = [r.norm_text for r in fusion.fused([("English", english), ("Russian", russian)]).orderBy("word_index").collect()]
    assert got == ["СОВЕТ", "a.exe", "plain"]
