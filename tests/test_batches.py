"""Many documents fold at once: batches, pieces and parts change nothing."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pagemill.functions import script as S
from pagemill.functions import text as T
from pagemill.operators import fusion
from test_pieces import COLUMNS, layout, slow_coverage, slow_lines

SORTED = ["candidate_score", "candidate", "word_index", "word_id"]


def parted(seeds=range(30)):
    return [layout(s, n=random.Random(s).choice([1, 2, 40, 160]), tall=0.1 * (s % 3)).assign(_score=lambda d: d["confidence"] // 10) for s in seeds]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coverage_folds_many_documents_at_once(spark, tiny):
    from pagemill.plans import registry

    found = plan(registry.QUERIES["coverage_merge"](spark, tiny))
    assert "FlatMapGroups" not in found and found.count("MapInArrow") == 1 and found.count("Window [") == 1 and found.count("Sort [") == 1
    frames = parted()
    want = [slow_coverage(f) for f in frames]
    mixed = pd.concat([f.sort_values(SORTED, ascending=[False, True, True, True]).assign(_part=i) for i, f in enumerate(frames)], ignore_index=True)
    kept = mixed.iloc[fusion.coverage_places(mixed, mixed["_part"].to_numpy())]
    assert [g["word_id"].tolist() for _, g in kept.groupby("_part")] == want


def test_lines_of_many_parts():
    frames = parted()
    boxes = [f[["x", "y", "w", "h"]].to_numpy() for f in frames]
    boxes[3][1::7, 3] = np.nan
    part = np.repeat(np.arange(len(boxes)), [len(b) for b in boxes])
    got = fusion.built_lines(np.concatenate(boxes), part)
    for i, b in enumerate(boxes):
        assert got[part == i].tolist() == slow_lines(b) if i != 3 else got[part == i].tolist() == fusion.built_lines(b).tolist()


def test_pairs_and_groups_of_many_parts():
    frames = parted()
    frames[5][["x", "w"]] *= 1e5  # boxes of another size have cells of their own
    mixed, part = pd.concat(frames, ignore_index=True), np.repeat(np.arange(len(frames)), [len(f) for f in frames])
    shuffled = np.random.default_rng(2).permutation(len(mixed))
    got = np.empty(len(mixed), np.int64)
    got[shuffled] = fusion.grouped_words(mixed.iloc[shuffled].reset_index(drop=True), part[shuffled])
    for i, f in enumerate(frames):
        alone, here = fusion.grouped_words(f), got[part == i]
        assert len({*zip(alone, here, strict=True)}) == len(set(alone)) == len(set(here))


def test_batches_that_break_off_in_a_document(spark, monkeypatch):
    rows = pd.concat([layout(s, n=n).assign(doc_id=s) for s, n in enumerate([160, 1, 160, 300, 2])], ignore_index=True)
    rows.loc[rows.index % 9 == 0, "norm_text"] = " "
    rows.loc[rows.index % 7 == 0, "text"] = None
    words = spark.createDataFrame(rows)
    branches = [(name, words.where(f"branch_index = {i}").select(*COLUMNS)) for i, name in enumerate(["English", "Russian", "English"])]
    folds = lambda: [sorted(map(str, d.select(*COLUMNS).collect())) for d in (fusion.fused(branches), fusion.coverage_merged(words.select(*COLUMNS, "candidate", "candidate_score")))]
    want = folds()
    assert all(len(w) > 100 for w in want) and any("text=None" in r for r in want[0])
    monkeypatch.setattr(fusion, "ROWS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert folds() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_out_of_order_are_an_error():
    table = lambda docs, n: pa.table({"doc_id": docs, "_n": n, "y": [0.0] * len(n), "h": [1.0] * len(n)})
    doc, starts, piece = fusion._cuts(table([5, 5, 6], [1, 2, 1]), 1)
    assert (doc.tolist(), starts.tolist(), piece.tolist()) == ([0, 0, 1], [True, False, True], [0, 0, 0])
    for wrong in (table([5, 6, 5], [1, 1, 2]), table([5, 5, 6], [1, 3, 1]), table([5, 5, 6], [1, 2, 2])):
        try:
            fusion._cuts(wrong, 1)
        except RuntimeError:
            continue
        raise AssertionError(wrong)


def test_fused_words_makes_each_text_once(spark, tiny):
    from pagemill.plans import registry

    found = plan(registry.QUERIES["fused_words"](spark, tiny))
    assert "FlatMapGroups" not in found and found.count("MapInArrow") == 1 and found.count("Window [") == 1
    tokens = ["жz", "жzжz", "abcd", "жабc", "ж.z", "ж☺z", "www.жz", "12ж", "a-b", "", None, "ABC1", "a☺", "é9", "x" * 30]
    rows = spark.createDataFrame([(t, c) for t in tokens for c in (None, 71.0)], "norm_text string, confidence double")
    t, c = F.col("norm_text"), S.script_counts(F.col("norm_text")) | {"protected": S.is_protected(F.col("norm_text"), codes=False)}
    telling = F.least(T.letters(t) + T.digits(t), F.lit(20))
    slow = 0.6 * F.coalesce("confidence", F.lit(fusion.WORD_CONFIDENCE)) + 2 * telling - T.symbols(t) - F.when(S.is_corrupted(t, c=c, stray=True), 18).otherwise(0)
    got = rows.select(fusion.coverage_preference(t, F.col("confidence")).alias("a"), slow.alias("b"), S.is_corrupted_reading(t).alias("c"), S.is_corrupted(t, c=c).alias("d")).collect()
    assert all(r["a"] == r["b"] and bool(r["c"]) == bool(r["d"]) for r in got) and sum(bool(r["c"]) for r in got) == 4


def test_routed_lines_fold_together(spark, monkeypatch):
    rows = pd.concat([layout(s, n=120).assign(doc_id=s, line_index=lambda d: (d["y"] // 90).astype(int)) for s in range(4)], ignore_index=True)
    words = spark.createDataFrame(rows)
    branches = [(name, words.where(f"branch_index = {i}").select(*COLUMNS)) for i, name in enumerate(["English", "Russian"])]
    routes = words.select("doc_id", "line_index").distinct().withColumn("route", F.expr("CASE WHEN line_index % 4 = 1 THEN 'Russian' WHEN line_index % 4 = 2 THEN 'English' ELSE 'Fused' END"))
    taken = lambda: sorted(map(str, fusion.routed(branches, routes).collect()))
    whole = taken()
    monkeypatch.setattr(fusion, "LINES", 1)  # each line by itself
    assert taken() == whole and len(whole) > 100
    found = fusion.routed(branches, routes)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [_lines" in found
