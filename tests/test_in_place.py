"""Correction word by word equals correction by tokens, in one pass whose code Java compiles."""

import random

from pyspark.sql import functions as F

from pagemill.functions import script as S
from pagemill.functions import text as T
from pagemill.operators import repair
from pagemill.plans import registry

LAYOUT = "doc_id long, word_id string, word_index long, line_index int, text string, norm_text string, x double, y double, w double, h double, confidence double"
ODD = ["(thexe,", "there", "THERE!", "ther", "[QUEEU]", "queue", "qeu", "()", "'", "''there''", "", " ", None, "therİ", "nation!!", "naxion\n", "a\nthere", "coy", "СОВЕТ", "COBET", "соy", "жабc", "a.ехе", "1.0а", "A4", "ж0ж", "o", "ace", "menter", "mentors", "mxxteur", "«menteur»", "tHeRe", "thеre", "yes", "straße"]
DICTIONARIES = [None, [], [("there", 1), ("nation", 1), ("queue", 2), ("menteur", 2)], [("queue", 0), ("qu", 2), ("", 1), ("there", 3), ("ПРИВЕТ", 1), ("İx", 1), ("a", 1)]]


def odd_words(spark):
    rng = random.Random(4)
    rows = [(d % 9 or None, f"w-{i}", i, i // 4 if i % 11 else None, t, t, 60.0 * i, 0.0, 50.0, 18.0, 80.0) for d in range(30) for i, t in enumerate(rng.choices(ODD, k=12))]
    return spark.createDataFrame(rows + [(99, f"w-{i}", i, 0, t, t, 0.0, 0.0, 1.0, 1.0, None) for i, t in enumerate(ODD)], LAYOUT)


def test_word_by_word_equals_by_tokens(spark, monkeypatch):
    words = odd_words(spark)
    for dictionary in DICTIONARIES:
        taken = lambda: sorted(map(str, repair.corrected(words, dictionary).collect()))  # noqa: B023, E731
        here = taken()
        with monkeypatch.context() as by_tokens:
            by_tokens.setattr(repair, "INLINE", -1)
            assert taken() == here and sum("changed=True" in r for r in here) > 5
        if dictionary:
            found = repair._with_repaired(words.select("norm_text").distinct(), "norm_text", dictionary, "repaired").where("repaired IS NOT NULL")
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, repair.repairs(words, dictionary).collect()))


def largest_method(spark, df):
    """Bytes of the longest Java method of a plan; from 8,000 on it is interpreted."""
    code = df._jdf.queryExecution().debug().codegenToSeq()
    return max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size()))


def one_pass(spark, sf_dir, name):
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        found = registry.QUERIES[name](spark, sf_dir)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("FileScan parquet") == 1 and "Scan ExistingRDD" not in plan, name
        assert 1000 < largest_method(spark, found) < 8000, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_postprocessed_words_reads_words_once(spark, tiny):
    one_pass(spark, tiny, "postprocessed_words")
    one_pass(spark, tiny, "corrected_words")


def test_postprocessed_analysis_reads_words_once(spark, tiny):
    one_pass(spark, tiny, "postprocessed_analysis")
    tokens = [*ODD, "WWW.x", "http://a", "a\\b", "x.Com", "acom", "x.zıp", "me@x", "\\Q", "a.json."]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string")
    slow = lambda t: any(x.upper() in t.upper() for x in S.PROTECTED)
    got = rows.select("t", T.contains_any(F.col("t"), S.PROTECTED), T.contains_any(F.col("t"), [])).collect()
    assert [tuple(r) for r in got] == [(t, None if t is None else slow(t), False) for t in tokens]
