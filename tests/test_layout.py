"""Small layouts with known outcomes, row order aside."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import script as S
from pagemill.functions import text as T
from pagemill.operators import choice, layout, noise, quality, repair
from pagemill.operators import query as Q
from pagemill.sources.layout import from_results, image_files, synthetic_words

WORDS = "doc_id string, word_id string, word_index int, line_index int, text string, norm_text string, x double, y double, w double, h double, confidence double"


def make(spark, rows, doc="d"):
    """rows: (line, x, y, w, h, text[, confidence])"""
    data = [(doc, f"w{i}", i, r[0], r[5], " ".join(r[5].split()), float(r[1]), float(r[2]), float(r[3]), float(r[4]), float(r[6]) if len(r) > 6 else None) for i, r in enumerate(rows)]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, WORDS)


def line(words, y, index, h=10.0, step=30.0):
    return [(index, i * step, y, 20.0, h, t) for i, t in enumerate(words)]


def text_of(words):
    return layout.reflowed(words).collect()[0].text


def test_reflow_keeps_lines_that_stand_apart_and_commas_close(spark):
    assert text_of(make(spark, line(["One", ",", "two"], 0, 0) + line(["Three", "four"], 20, 1))) == "One, two\nThree four"


def test_reflow_joins_close_lines_that_go_on(spark):
    assert text_of(make(spark, line(["Some", "words"], 0, 0) + line(["go", "on"], 14, 1))) == "Some words go on"


def test_reflow_keeps_list_items(spark):
    assert text_of(make(spark, line(["Shopping"], 0, 0) + line(["-", "milk"], 13, 1) + line(["-", "bread"], 26, 2))) == "Shopping\n- milk\n- bread"


def test_reflow_paragraphs_and_empty(spark):
    assert text_of(make(spark, line(["One."], 0, 0) + line(["Two."], 40, 1))) == "One.\n\nTwo."
    assert layout.reflowed(make(spark, [])).count() == 0


def test_lists_decide_and_fall_back(spark):
    words = make(spark, line(["a", "b"], 0, 0) + line(["c"], 20, 1))
    lines = layout.lines_of(words)
    assert layout.line_words(lines.where("line_index = 0"), words).count() == 2
    assert layout.lines_or_words(lines.where("line_index = 7"), words).count() == 3


def test_range_and_text_of_a_selection(spark):
    words = make(spark, line(["a1", "b2"], 0, 0) + line(["c3", "d4"], 20, 1))
    picked = Q.range_selection(words, spark.createDataFrame([("d", 3, 1)], "doc_id string, anchor int, active int"))
    assert picked.count() == 3
    assert Q.selection_text(picked).collect()[0].text == "b2\nc3 d4"
    assert Q.full_selection(words).collect()[0][1:] == (0, 3, 4)


@pytest.mark.parametrize(("px", "hit"), [(22.0, True), (22.5, True), (24.0, False)])
def test_nearest_word(spark, px, hit):
    words = make(spark, [(0, 0, 0, 20, 10, "a")])
    found = Q.nearest_word(words, spark.createDataFrame([("d", 1, px, 5.0, 3.0)], "doc_id string, point_id int, px double, py double, tolerance double")).collect()[0]
    assert (found.word_id, found.is_hit) == ("w0", hit)


def test_nearest_word_tie_goes_to_the_lower_index(spark):
    words = make(spark, [(0, 0, 0, 10, 10, "a"), (0, 20, 0, 10, 10, "b")])
    assert Q.nearest_word(words, spark.createDataFrame([("d", 1, 15.0, 5.0, 9.0)], "doc_id string, point_id int, px double, py double, tolerance double")).collect()[0].word_id == "w0"


def kept(spark, rows, strict=False):
    return [r.norm_text for r in noise.without_noise(make(spark, rows), strict).orderBy("word_index").collect()]


def test_noise_drops_a_lone_icon_and_keeps_text(spark):
    assert kept(spark, [(0, 0, 0, 24, 24, "◆"), (1, 0, 40, 60, 18, "Real"), (1, 70, 40, 60, 18, "text")]) == ["Real", "text"]


def test_noise_keeps_short_tokens_and_marks_beside_text(spark):
    assert kept(spark, [(0, 0, 0, 10, 18, "a", 3), (0, 14, 0, 20, 18, "7"), (1, 0, 40, 20, 18, "#"), (2, 0, 80, 30, 18, "ok"), (2, 32, 80, 8, 18, "»")]) == ["a", "7", "#", "ok", "»"]


def test_noise_of_nothing(spark):
    assert kept(spark, []) == []
    assert kept(spark, [(0, 0, 0, 90, 10, "~~~")], strict=True) == []


def test_fragments_merge_only_when_they_touch(spark):
    close = make(spark, [(0, 0, 0, 40, 20, "frag"), (0, 41, 0, 50, 20, "ment", 80), (0, 120, 0, 30, 20, "end")])
    out = layout.merged_fragments(close).orderBy("word_index").collect()
    assert [(r.norm_text, r.parts) for r in out] == [("fragment", 2), ("end", 1)]
    assert (out[0].x, out[0].w, out[0].confidence, out[0].word_id) == (0.0, 91.0, 80.0, "w0")
    apart = make(spark, [(0, 0, 0, 10, 20, "a"), (0, 14.8, 0, 50, 20, "word")])
    assert layout.merged_fragments(apart).count() == 2


def test_rectangles_of_a_selection(spark):
    words = make(spark, [(0, 0, 0, 10, 10, "a"), (0, 14, 0, 10, 10, "b"), (0, 60, 0, 10, 10, "c"), (1, 0, 20, 10, 10, "d")])
    assert sorted((r.line_index, r.x, r.w) for r in layout.merged_rects(words).collect()) == [(0, 0.0, 24.0), (0, 60.0, 10.0), (1, 0.0, 10.0)]


def test_row_runs_and_regions_against_loops(spark):
    rng = random.Random(5)
    ink = {d: [rng.choice([0, 0, 3]) for _ in range(60)] for d in range(8)}
    got = {}
    for r in layout.row_runs(spark.createDataFrame([(d, y, n) for d, xs in ink.items() for y, n in enumerate(xs)], "doc_id int, y int, ink int")).collect():
        got.setdefault(r.doc_id, []).append((r.top, r.bottom))
    for d, xs in ink.items():
        runs = []
        for y in (y for y, n in enumerate(xs) if n):
            if runs and y - runs[-1][1] <= 3:
                runs[-1][1] = y
            else:
                runs.append([y, y])
        assert sorted(got.get(d, [])) == [tuple(r) for r in runs]
    boxes = [(0, float(a), float(a + rng.randint(1, 30))) for a in rng.sample(range(600), 40)]
    merged = []
    for _, a, b in sorted(boxes):
        if merged and a <= merged[-1][1] + 4:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    found = layout.merged_regions(spark.createDataFrame(boxes, "doc_id int, top double, bottom double")).collect()
    assert sorted((r.top, r.bottom) for r in found) == [tuple(m) for m in merged]


def test_viewport_round_trip(spark):
    zoom, pan = G.zoomed_pan(F.lit(120.0), F.lit(0.5), F.lit(7.0), F.lit(2.0))
    r = spark.range(1).select(G.to_image(F.lit(120.0), F.lit(0.5), F.lit(7.0)).alias("before"), G.to_image(F.lit(120.0), zoom, pan).alias("after"), G.fit_zoom(*map(F.lit, (200.0, 100.0, 400.0, 400.0))).alias("fit")).first()
    assert r.before == pytest.approx(r.after, abs=1e-3)
    assert r.fit == 0.25


def test_screen_boxes_and_pointer(spark):
    box = G.pixel_box(*map(F.lit, (30.0, 20.0, 10.0, 40.2, 100.0, 100.0, 1.5, 1.5)))
    r = spark.range(1).select(*box, G.drag_intent(F.lit(1.0), F.lit(1.0), F.lit(True), F.lit(False)).alias("a"), G.drag_intent(F.lit(9.0), F.lit(1.0), F.lit(True), F.lit(False)).alias("b")).first()
    assert (r.px, r.py, r.pw, r.ph, r.a, r.b) == (15, 30, 30, 31, "click", "select")


def test_script_repair(spark):
    rows = [(0, 0, 0, 50, 18, "прuвет"), (0, 60, 0, 50, 18, "мир"), (0, 120, 0, 50, 18, "сообщение"), (1, 0, 30, 50, 18, "https://a.com/cop"), (1, 60, 30, 50, 18, "пpивет,")]
    out = {r.word_id: r for r in repair.corrected(make(spark, rows)).collect()}
    assert out["w4"].norm_text == "привет," and out["w4"].changed
    assert out["w3"].norm_text == "https://a.com/cop" and not out["w3"].changed
    assert out["w4"].x == 60.0


def test_dictionary_keeps_affixes_and_order(spark):
    rows = [(0, 0, 0, 50, 18, "(servce),"), (0, 60, 0, 50, 18, "plain")]
    out = sorted(r.norm_text for r in repair.corrected(make(spark, rows), [("service", 1), ("servce", 1)]).collect())
    assert out == ["(service),", "plain"]


def test_program_and_installer_names(spark):
    tokens = spark.createDataFrame([("notpad.ехе",), ("plain",), ("Browzer_setup_12.4",)], "norm_text string")
    programs = {r.norm_text: r.program for r in repair.program_names(tokens, ["notepad"]).collect()}
    installers = {r.norm_text: r.installer for r in repair.installer_names(tokens, ["Browser"]).collect()}
    assert programs == {"notpad.ехе": "notepad.exe", "plain": None, "Browzer_setup_12.4": None}
    assert installers == {"Browzer_setup_12.4": "Browser-setup-12.4.exe", "plain": None, "notpad.ехе": None}
    assert repair.program_names(tokens, []).where("program IS NOT NULL").collect()[0].program == "notpad.exe"
    assert spark.range(1).select(T.longest_digit_run(F.lit("a1.2 .3456. 67"))).first()[0] == "3456"


def test_scores_prefer_clean_text(spark):
    clean = make(spark, line(["plain", "words", "here"], 0, 0), "clean")
    dirty = make(spark, line(["plаin", "wоrds", "q"], 0, 0), "dirty")
    score = {r.doc_id: r.score for r in quality.document_scores(clean.unionByName(dirty)).collect()}
    assert score["clean"] > score["dirty"]
    assert quality.document_scores(make(spark, [])).count() == 0


def test_candidates(spark):
    rows = [("d", "Fast", "English", 50.0, 0), ("d", "Accurate", "Russian", 46.0, 0), ("e", "Fast", "English", 50.0, 0), ("e", "Accurate", "Russian", 30.0, 0)]
    scores = spark.createDataFrame(rows, "doc_id string, engine_id string, language string, score double, corrupted_words int")
    best = {r.doc_id: r.engine_id for r in quality.best_candidates(scores, "Russian").collect()}
    assert best == {"d": "Accurate", "e": "Fast"}
    assert {r.engine_id for r in quality.best_candidates(scores, "Auto").collect()} == {"Fast"}


def test_image_rules(spark):
    stats = spark.createDataFrame([("dark", "x.png", 500, 400, 60.0, 40, 0.2), ("clean", "y.png", 1600, 1200, 200.0, 200, 0.05)], "doc_id string, path string, pixel_w int, pixel_h int, avg_luminance double, contrast_range int, edge_density double")
    flagged = choice.image_flags(stats)
    plans = {r.doc_id: r for r in flagged.withColumns(choice.preprocessing_plan()).withColumn("e", choice.engine_choice(F.lit("Auto"), F.lit("English"), F.col("path"))).collect()}
    assert plans["dark"].invert and plans["dark"].scale == 3.0 and plans["dark"].e == "Accurate"
    assert not plans["clean"].invert and plans["clean"].scale == 1.0 and plans["clean"].e == "Fast"
    assert choice.variants(flagged.withColumns(choice.preprocessing_plan())).where("doc_id = 'clean'").count() == 1


def test_sources(spark, tmp_path):
    for name in ("a.PNG", "b.txt", "c.webp"):
        (tmp_path / name).write_bytes(b"x")
    assert image_files(spark, str(tmp_path)).count() == 2
    results = spark.createDataFrame([("d", [{"words": [{"text": " a ", "x": 2.0, "y": 2.0, "w": 4.0, "h": 4.0, "confidence": None}, {"text": " ", "x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0, "confidence": 1.0}]}])], "doc_id string, lines array<struct<words:array<struct<text:string,x:double,y:double,w:double,h:double,confidence:double>>>>")
    out = from_results(results, 2.0, 2.0).collect()
    assert [(r.norm_text, r.x, r.w, r.word_index) for r in out] == [("a", 1.0, 2.0, 0)]
    docs = spark.createDataFrame([("d", "ab c\n\nd"), ("n", None), ("e", "")], "doc_id string, text string")
    assert sorted((r.line_index, r.text) for r in synthetic_words(docs).collect()) == [(0, "ab"), (0, "c"), (2, "d")]


def test_scripts(spark):
    r = spark.range(1).select(S.token_script(F.lit("abв")).alias("a"), S.dominance(F.lit(0), F.lit(0)).alias("b"), S.cleaned(F.lit("wоrd")).alias("c"), S.skeleton(F.lit("С0de5!")).alias("d"), S.is_corrupted(F.lit("wоrd")).alias("e"), S.looks_cyrillic(F.lit("CAXAP")).alias("f")).first()
    assert tuple(r) == ("latin", "none", "word", "codes", True, True)


def test_many_lines_and_long_lines(spark):
    docs = spark.createDataFrame([(1, "a b\n" * 25_000), (2, "w " * 120_000 + "\nlast")], "doc_id long, text string")
    words = synthetic_words(docs)
    found = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word_index").alias("places"), F.max("line_index").alias("line"), F.max_by("text", "word_index").alias("last"))
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == {1: (50_000, 50_000, 24_999, "b"), 2: (120_001, 120_001, 1, "last")}


def test_folds_and_noise_of_a_long_line(spark):
    n = 50_000
    text = F.when(F.col("id") % 5 == 0, "→").otherwise("word")
    x = F.col("id") * 40.0 + F.when(F.col("id") % 5 == 0, 15.0).otherwise(0.0)
    words = spark.range(n).select(F.lit(1).alias("doc_id"), F.concat(F.lit("w"), "id").alias("word_id"), F.col("id").alias("word_index"), F.lit(0).alias("line_index"), text.alias("text"), text.alias("norm_text"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(20.0).alias("w"), F.lit(10.0).alias("h"), F.lit(50.0).alias("confidence"))
    began = time.perf_counter()
    assert layout.merged_rects(words).count() == n - n // 5  # a mark lies close to the word after it
    assert layout.merged_fragments(words).count() == n
    reasons = {r.reason: r["count"] for r in noise.reject_reason(words).groupBy("reason").count().collect()}
    assert reasons == {None: n}
    lone = noise.reject_reason(words.where("word_index % 5 = 0")).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in lone} == {"symbol": n // 5}
    assert time.perf_counter() - began < 60


def test_connected_words_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i % 3, f"w{i}", i, rng.randrange(3), t, t, rng.uniform(0, 900), rng.uniform(0, 20), rng.uniform(1, 200), rng.uniform(1, 60), 1.0) for i in range(240) for t in [rng.choice(["word", "☂", "→", "12"])]]
    words = spark.createDataFrame(rows, "doc_id long, word_id string, word_index long, line_index int, text string, norm_text string, x double, y double, w double, h double, confidence double")
    textual = {r.word_id for r in words.where(T.is_textual(F.col("norm_text"))).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[1] not in textual and b[1] in textual and a[0] == b[0] and a[3] == b[3]:
                gap = max(b[6] - a[6] - a[8], a[6] - b[6] - b[8])
                shared = min(a[7] + a[9], b[7] + b[9]) - max(a[7], b[7])
                if gap <= noise.NEAR_GAP * max(a[9], b[9]) and shared >= noise.NEAR_OVERLAP * min(a[9], b[9]):
                    want.add((a[0], a[1]))
    assert {tuple(r) for r in noise.connected(words, T.is_textual(F.col("norm_text"))).collect()} == want and len(want) > 20


def test_nearest_word_within_a_thousandth(spark):
    words = spark.createDataFrame([(1, f"w{i}", i, "t", x, 0.0, 1.0, 1.0) for i, x in enumerate([10.00051, 10.00049, 10.0016, 10.002])], "doc_id long, word_id string, word_index long, norm_text string, x double, y double, w double, h double")
    point = spark.createDataFrame([(1, 0, 0.0, 0.5, 12.0)], "doc_id long, point_id long, px double, py double, tolerance double")
    assert [r.word_id for r in Q.nearest_word(words, point).collect()] == ["w0"]
    assert [r.word_id for r in Q.nearest_word(words.where("word_index > 0"), point).collect()] == ["w1"]
    assert [r.word_id for r in Q.nearest_word(words.where("word_index > 1"), point).collect()] == ["w2"]


def test_variants_of_token_rules(spark):
    t = F.col("t")
    df = spark.createDataFrame([("AB1",), ("setup.exe",), ("Delete",), ("аb",), ("аb→",), ("аbcd",), ("kК",)], "t string")
    rows = df.select("t", S.is_protected(t).alias("codes"), S.is_protected(t, codes=False).alias("plain"), S.is_protected(t, ["exe"], False, ["delete"]).alias("named"), S.is_corrupted(t).alias("long"), S.is_corrupted(t, 1).alias("any"), S.is_corrupted(t, stray=True).alias("stray"), S.script_counts(t, *S.FUSION_LOOKS)["latin_alike"].alias("fusion"), S.script_counts(t)["latin_alike"].alias("alike"))
    got = {r.t: tuple(r)[1:] for r in rows.collect()}
    assert got["AB1"] == (True, False, False, False, False, False, 2, 2)
    assert got["setup.exe"][:3] == (True, True, True) and got["Delete"][:3] == (False, False, True)
    assert got["аb"][3:6] == (False, True, False) and got["аb→"][3:6] == (False, True, True) and got["аbcd"][3:6] == (True, True, True)
    assert got["kК"][6:] == (0, 1)


def test_headings_are_written_larger(spark):
    rows = lambda h: [(0, 0, 0, 50, h, "Some"), (0, 60, 0, 50, h, "title"), (1, 0, 30, 50, 20, "then"), (1, 60, 30, 50, 20, "words")]
    breaks = lambda h: [r["break"] for r in layout.line_breaks(layout.export_lines(make(spark, rows(h)))).orderBy("line_index").collect()]
    assert breaks(25.0) == ["first", "newline"] and breaks(22.0) == ["first", "space"]
    ended = [(0, 0, 0, 50, 25.0, "Done."), (1, 0, 30, 50, 20.0, "then")]
    assert [r["break"] for r in layout.line_breaks(layout.export_lines(make(spark, ended))).orderBy("line_index").collect()] == ["first", "space"]
    many = [(0, 20 * i, 0, 15, 25.0, f"w{i}") for i in range(9)] + [(1, 0, 30, 50, 20.0, "then")]
    assert [r["break"] for r in layout.line_breaks(layout.export_lines(make(spark, many))).orderBy("line_index").collect()] == ["first", "space"]


def test_codes_are_protected_in_correction_alone(spark):
    df = spark.createDataFrame([("AB1",), ("a.exe",)], "norm_text string")
    protected = lambda codes: [r._protected for r in S.with_counts(df, codes=codes).collect()]
    assert protected(True) == [True, True] and protected(False) == [False, True]
