"""What the findings of larger tables came to: results that differed from SQL, and words that travelled."""

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import quality

LAYOUT = "doc_id long, word_id string, word_index long, line_index int, text string, norm_text string, x double, y double, w double, h double, confidence double"


def word(doc, i, text, line=0, x=None, w=40.0):
    return (doc, f"w-{line}-{i}", line * 100 + i, line, text, text, 160.0 * i if x is None else x, 24.0 * line, w, 18.0, 80.0)


def test_letters_keep_their_number_in_upper_case(spark):
    rows = spark.createDataFrame([("daß",), ("dass",), ("ß",), ("ﬁne",), ("ᾳx",), ("Éa-1",), ("ŉ",)], "t string")
    assert [r[0] for r in rows.select(T.folded(F.col("t"))).collect()] == ["DAẞ", "DASS", "ẞ", "ﬁNE", "ᾼX", "ÉA1", "ŉ"]
    words = spark.createDataFrame([word(1, i, t) for i, t in enumerate(["daß", "daß", "dass", "dass"])], LAYOUT)
    assert [tuple(r) for r in quality.duplicate_penalty(words).collect()] == [(1, 0)]
    assert quality.document_scores(words).first()["penalty"] == 0


def exchanges(df):
    """What the plan deals anew, one line an exchange."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_words_dealt_by_document_stay_there(spark, tiny):
    from pagemill.plans import registry

    for name in ("coverage_merge", "fused_words", "line_boxes", "rect_merge", "fragment_merge", "reflow_text", "listed_words", "listed_or_all_words", "overlap_pairs", "token_skeletons", "noise_reasons", "postprocessed_words", "postprocessed_analysis"):
        found = exchanges(registry.QUERIES[name](spark, tiny))
        assert found and all("REPARTITION_BY_NUM" in line for line in found), (name, found)
    assert len(exchanges(registry.QUERIES["nearest_word"](spark, tiny))) == 1


def test_words_on_lines_that_list_them_again(spark):
    from pagemill.operators import layout

    words = spark.createDataFrame([word(1, 0, "a"), word(1, 1, "b"), word(2, 0, "c"), word(None, 0, "d")], LAYOUT)
    lines = spark.createDataFrame([(1, 5, ["w-0-0", "w-0-0", "gone"]), (1, 6, ["w-0-0"]), (None, 7, ["w-0-0"])], "doc_id long, line_index int, word_ids array<string>")
    kept = lambda df: sorted((r["doc_id"] or 0, r["text"], r["line_index"]) for r in df.collect())
    assert kept(layout.line_words(lines, words)) == [(1, "a", 5), (1, "a", 5), (1, "a", 6)]
    assert kept(layout.lines_or_words(lines, words)) == [(0, "d", 0), (1, "a", 5), (1, "a", 5), (1, "a", 6), (2, "c", 0)]


def test_a_context_meets_its_places_once(spark):
    from pagemill.llm.substring_dedup import _runs_of_contexts

    starts = [(7, 1, 2, i, i + 1) for i in (*range(50), *range(60, 64))] + [(7, 1, 2, 10, 30), (7, 1, 3, 5, 9)]
    found = _runs_of_contexts(spark.createDataFrame(starts, "_key long, _c1 long, _c2 long, _from long, _to long")).collect()
    assert sorted((r["_c2"], sorted(tuple(x) for x in r["_runs"])) for r in found) == [(2, [(0, 50), (60, 64)]), (3, [(5, 9)])]


def test_a_reading_deals_its_documents_by_size(spark, tiny):
    from pagemill.plans import registry

    found = exchanges(registry.evaluated(registry.documents(spark, tiny).select("doc_id", "text"), "Fast", "English"))
    assert len(found) == 1 and "REPARTITION_BY_NUM" in found[0]


def test_words_are_grouped_once_to_be_merged(spark):
    import random

    from pagemill.operators import layout

    rng = random.Random(14)
    rows = []
    for line in range(40):
        x = 0.0
        for i in range(rng.choice([1, 2, 9, 30])):
            w = rng.choice([10.0, 20.0, 55.0])
            rows.append((line % 3, f"w-{line}-{i}", line * 100 + i, line, "", rng.choice(["ab", "cd", "жук", "жz", "12", "a", "x-y", "é9", None]), x, 24.0 * line, w, rng.choice([17.0, 18.0]), rng.choice([60.0, 85.0, None])))
            x += w + rng.choice([0.0, 0.0, 1.0, -1.5, 2.5, 9.0])
    words = spark.createDataFrame(rows, LAYOUT)
    merged = layout.merged_fragments(words)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Window" not in plan and plan.count("sort_array") == 1, plan

    cyrillic = lambda t: any("Ѐ" <= c <= "ԯ" for c in t)
    script = lambda t: "c" if cyrillic(t) else "l" if any(c.isalpha() for c in t) else None
    wanted, group = [], None
    for d, i, at, line, _, t, x, y, w, h, confidence in rows:
        if group and group["line"] == line:
            a, reach = group["t"], 0.12 * (group["h"] + h) / 2
            plain = all(s and s.isalnum() and len(s) > 1 for s in (a, t))
            if plain and script(a) in (script(t), None) or plain and script(t) is None:
                if -reach <= x - (group["x"] + group["w"]) <= reach:
                    top, right, bottom = min(group["y"], y), max(group["x"] + group["w"], x + w), max(group["y"] + group["h"], y + h)
                    c = confidence if group["c"] is None else group["c"] if confidence is None else (group["c"] + confidence) / 2
                    left = min(group["x"], x)
                    group |= {"t": a + t, "x": left, "y": top, "w": right - left, "h": bottom - top, "c": c, "n": group["n"] + 1}
                    continue
        group = {"d": d, "id": i, "at": at, "line": line, "t": t, "x": x, "y": y, "w": w, "h": h, "c": confidence, "n": 1}
        wanted.append(group)
    found = merged.select("doc_id", "word_id", "word_index", "line_index", "text", "x", "y", "w", "h", "confidence", "parts").collect()
    assert {tuple(r) for r in found} == {tuple(g.values()) for g in ({k: g[k] for k in ("d", "id", "at", "line", "t", "x", "y", "w", "h", "c", "n")} for g in wanted)}
    assert len(found) == len(wanted) and max(g["n"] for g in wanted) > 3


def plain_regions(y, how):
    """``Segmentation.regions`` pixel by pixel, where it finds lines."""
    height, width = y.shape
    limit = y.mean() - 0.35 * (y.mean() - y.min())
    ink = [[v < limit for v in row] for row in y.tolist()]
    runs = []
    for i in (i for i, row in enumerate(ink) if sum(row) >= how.row_ink):
        if runs and i - runs[-1][1] <= how.gap + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    found = []
    for top, bottom in runs:
        end = height if height - 1 - bottom <= how.gap else bottom + 1
        dark = [x for x in range(width) if sum(row[x] for row in ink[top:end]) >= max(1.0, how.column_share * (end - top))]
        if end - top < how.shortest or not dark:
            continue
        box = [max(dark[0] - how.pad, 0), max(top - how.pad, 0), min(dark[-1] + 1 + how.pad, width), min(end + how.pad, height)]
        if found and box[1] - found[-1][3] <= how.close * height:
            box = [min(found[-1][0], box[0]), found[-1][1], max(found[-1][2], box[2]), max(found[-1][3], box[3])]
            found.pop()
        found.append(box)
    return [(*box, "line") for box in found]


def test_many_images_are_handed_on_together():
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd
    from pyspark.sql.types import LongType

    from pagemill.operators import images

    rng, rows, wanted = np.random.default_rng(21), [], []
    how = images.Segmentation(row_ink=2, gap=1, shortest=2, column_share=0.3, pad=1, close=0.02)
    for k in range(300):
        height, width = int(rng.integers(1, 50)), int(rng.integers(1, 20))
        y = np.where(rng.random((height, width)) < 0.4, rng.integers(0, 90, (height, width)), 255).astype(np.uint8)
        y[rng.random(height) < 0.5] = 255
        rows.append((k, width, height, 4 * width, np.repeat(y[..., None], 4, axis=2).tobytes()))
        wanted += [(k, *box) for box in plain_regions(images.luminance(images.pixels_of(*rows[-1][1:])), how)]
    given = SimpleNamespace(schema={"doc_id": SimpleNamespace(dataType=LongType())}, mapInPandas=lambda f, schema: f)
    given.select = lambda *names: given
    frames = list(images.text_regions(given, how)(iter([pd.DataFrame(rows, columns=["doc_id", "width", "height", "stride", "pixels"])])))
    assert len(frames) == 1
    found = [(r.doc_id, r.x, r.y, r.x + r.w, r.y + r.h, r.kind) for r in frames[0].itertuples() if r.kind == "line"]
    assert len(wanted) > 300 and found == wanted
    crops = list(images.text_regions(given, how, crops=True)(iter([pd.DataFrame(rows, columns=["doc_id", "width", "height", "stride", "pixels"])])))
    assert sum(map(len, crops)) == len(frames[0])


def test_a_short_dictionary_meets_tokens_where_they_are(spark):
    from pagemill.operators import repair

    tokens = spark.createDataFrame([("(thexe,",), ("thexe",), ("there",), ("[QUEEU]",), ("()",), ("",), (None,), ("therİ",), ("nation!!",)], "norm_text string")
    found = repair.repairs(tokens.union(tokens), [("there", 1), ("queue", 2)])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(map(tuple, found.collect())) == sorted([("(thexe,", "(there,"), ("thexe", "there"), ("there", "there"), ("[QUEEU]", "[queue]")])
