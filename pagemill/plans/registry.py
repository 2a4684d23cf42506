"""The library's named queries over the tables of a folder, and the same in DuckDB SQL.

Every query reads whole tables. Layout queries lay ``documents`` out with ``synthetic_words``; the SQL repeats that layout.
Queries without SQL (ordered folds, numpy on pixels, hashed jitter) are tested against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import script as S
from pagemill.functions import text as T
from pagemill.operators import choice, fusion, images, layout, noise, quality, repair, staging
from pagemill.operators import query as Q
from pagemill.sources import settings
from pagemill.sources.layout import LINE_STEP, dealt, jittered, synthetic_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WORDS_SQL = r"""
    l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    l1 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_index FROM l0),
    t0 AS (SELECT doc_id, line_index, string_split(line, ' ') AS ws FROM l1),
    t1 AS (SELECT doc_id, line_index, unnest(ws) AS text, unnest(range(len(ws))) AS pos FROM t0),
    words AS (
        SELECT doc_id, 'w-' || line_index || '-' || pos AS word_id, line_index::BIGINT * 4294967296 + pos AS word_index, line_index, text,
               trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm_text, 160.0::DOUBLE * pos AS x, 24.0::DOUBLE * line_index AS y,
               greatest(10, 8 * length(text))::DOUBLE AS w, 18.0::DOUBLE AS h, (60 + (length(text) * 7 + pos * 3) % 40)::DOUBLE AS confidence
        FROM t1 WHERE text <> '')
"""
EXPORT_SQL = WORDS_SQL + r""",
    before AS (SELECT *, lag(norm_text) OVER (PARTITION BY doc_id, line_index ORDER BY word_index) AS prev FROM words),
    spaced AS (
        SELECT *, prev IS NULL OR NOT regexp_matches(prev, '\S') OR regexp_matches(norm_text, '^[,.;:!?)\]}%»]') OR regexp_matches(prev, '[(\[{«]$') AS joined
        FROM before),
    export AS (
        SELECT doc_id, line_index, min(x) AS "left", min(y) AS top, max(x + w) AS "right", max(y + h) AS bottom, avg(greatest(1.0, h)) AS mean_height, count(*) AS n_words,
               string_agg(CASE WHEN joined THEN norm_text ELSE ' ' || norm_text END, '' ORDER BY word_index) AS text
        FROM spaced GROUP BY doc_id, line_index),
    lines AS (SELECT * FROM export WHERE regexp_matches(text, '\S'))
"""
BREAKS_SQL = EXPORT_SQL + r""",
    seen AS (
        SELECT *, lag(text) OVER o AS p_text, lag(n_words) OVER o AS p_words, lag(mean_height) OVER o AS p_height, top - lag(bottom) OVER o AS gap, (mean_height + lag(mean_height) OVER o) / 2 AS height
        FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY line_index)),
    breaks AS (
        SELECT *, CASE
            WHEN p_text IS NULL THEN 'first'
            WHEN gap > 1.2 * height THEN 'paragraph'
            WHEN regexp_matches(text, '^(?:[-*•‣–]|\d{1,3}[.)]|[a-z][.)])\s') THEN 'newline'
            WHEN p_words <= 8 AND NOT regexp_matches(p_text, '[.!?…][)"''»]*$') AND p_height >= 1.12::DOUBLE * mean_height THEN 'newline'
            WHEN gap >= 0.8 * height THEN 'newline'
            WHEN regexp_matches(p_text, '\p{L}-$') AND regexp_matches(text, '^\p{Ll}') THEN 'none'
            WHEN regexp_matches(p_text, '[.!?…][)"''»]*$') AND NOT regexp_matches(text, '^\p{Ll}') THEN 'newline'
            ELSE 'space' END AS "break"
        FROM seen)
"""
SCRIPTS_SQL = WORDS_SQL + r""",
    counted AS (
        SELECT *, len(regexp_extract_all(norm_text, '\p{Latin}')) AS latin, len(regexp_extract_all(norm_text, '\p{Cyrillic}')) AS cyrillic,
               len(regexp_extract_all(norm_text, '[ABCEHKMOPTXYaceopxyk]')) AS latin_alike, len(regexp_extract_all(norm_text, '[АВСЕНКМОРТХУасеорхук]')) AS cyrillic_alike,
               len(regexp_extract_all(norm_text, '\p{Nd}')) AS digit,
               regexp_matches(upper(norm_text), '://|WWW\.|@|\\|\.COM|\.ORG|\.NET|\.EXE|\.DLL|\.ZIP|\.JSON') AS protected
        FROM words),
    judged AS (
        SELECT *, latin > 0 AND cyrillic > 0 AND length(norm_text) >= 4 AND NOT protected AS corrupted,
               NOT protected AND ((latin >= 3 AND cyrillic = 0 AND latin = latin_alike) OR (cyrillic >= 3 AND latin = 0 AND cyrillic = cyrillic_alike)) AS ambiguous
        FROM counted)
"""
SCORES_SQL = SCRIPTS_SQL + r""",
    base AS (
        SELECT doc_id, count(*) AS n_words, sum(len(regexp_extract_all(norm_text, '\p{L}')) + digit) AS alnum, coalesce(avg(confidence), 70.0) AS mean_confidence,
               count(*) FILTER (regexp_matches(norm_text, '^\p{L}$') AND lower(norm_text) NOT IN ('a','i','o','à','y','e','u','и','в','с','к','о','у','я','а')) AS single_noise,
               sum(contains(upper(norm_text), 'TION')::INT + contains(upper(norm_text), 'MENT')::INT) AS known_terms,
               count(*) FILTER (corrupted) AS corrupted_words, count(*) FILTER (ambiguous) AS ambiguous_words
        FROM judged GROUP BY doc_id),
    tokens AS (SELECT doc_id, upper(regexp_replace(norm_text, '[^\p{L}\p{Nd}]', '', 'g')) AS token FROM words),
    dup AS (SELECT doc_id, sum(greatest(0, n - 2)) AS penalty FROM (SELECT doc_id, token, count(*) AS n FROM tokens WHERE length(token) >= 3 GROUP BY ALL) GROUP BY doc_id),
    faults AS (SELECT base.*, coalesce(penalty, 0) AS penalty FROM base LEFT JOIN dup USING (doc_id)),
    scored AS (SELECT *, greatest(0.0, 0.4 * mean_confidence + 10 * ln(1 + alnum::DOUBLE) + 3 * known_terms - 100 * (8 * corrupted_words + 2 * ambiguous_words + 1.5::DOUBLE * single_noise + penalty) / n_words * 0.1::DOUBLE) AS score FROM faults)
"""
TERMS = ["tion", "ment"]
DICTIONARY = [("there", 1), ("nation", 1), ("queue", 2), ("menteur", 2)]


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_words(dealt(documents(spark, sf_dir)), step=160)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"""WITH {WORDS_SQL}
    SELECT doc_id, count(*) AS n_words, sum(len(regexp_extract_all(norm_text, '\\p{{L}}')))::BIGINT AS letters, sum(len(regexp_extract_all(norm_text, '\\p{{Nd}}')))::BIGINT AS digits,
           sum(len(regexp_extract_all(norm_text, '[\\p{{So}}\\p{{Sm}}\\p{{Sc}}\\p{{Sk}}]')))::BIGINT AS symbols, sum(length(norm_text))::BIGINT AS chars, round(avg(length(norm_text)), 6) AS mean_length
    FROM words GROUP BY doc_id""")
def token_class_profile(spark, sf_dir):
    """Flagship: characters by class, and mean word length, of each document."""
    t = F.col("norm_text")
    out = words(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum(T.letters(t)).alias("letters"), F.sum(T.digits(t)).alias("digits"), F.sum(T.symbols(t)).alias("symbols"), F.sum(F.length(t)).alias("chars"), F.avg(F.length(t)).alias("mean_length"))
    return rounded(out, "mean_length")


@query(f"""WITH {WORDS_SQL}
    SELECT doc_id, line_index::BIGINT AS line_index, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n_words, string_agg(text, ' ' ORDER BY word_index) AS text
    FROM words GROUP BY doc_id, line_index""")
def line_boxes(spark, sf_dir):
    return longs(layout.lines_of(words(spark, sf_dir)).select("doc_id", "line_index", "x", "y", "w", "h", "n_words", "text"), "line_index")


@query(f"""WITH {WORDS_SQL}, kept AS (SELECT doc_id, word_id, line_index, word_index FROM words QUALIFY count(*) OVER (PARTITION BY doc_id, line_index) >= 3)
    SELECT doc_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY line_index) - 1)::BIGINT AS line_index, (row_number() OVER (PARTITION BY doc_id ORDER BY line_index, word_index) - 1)::BIGINT AS word_index, word_id FROM kept""")
def listed_words(spark, sf_dir):
    """Words by the id lists of lines of three words or more, renumbered: the others are listed by no line and drop out."""
    w = words(spark, sf_dir)
    kept = layout.line_words(layout.lines_of(w).where("n_words >= 3"), w)
    return longs(layout.renumbered(kept).select("doc_id", "line_index", "word_index", "word_id"), "line_index", "word_index")


@query(f"""WITH {WORDS_SQL}, listed AS (SELECT * FROM words QUALIFY count(*) OVER (PARTITION BY doc_id, line_index) >= 12), rest AS (SELECT * FROM words WHERE doc_id NOT IN (SELECT doc_id FROM listed))
    SELECT doc_id, count(*) AS n_words FROM (SELECT * FROM listed UNION ALL SELECT * FROM rest) GROUP BY doc_id""")
def listed_or_all_words(spark, sf_dir):
    """Lines of twelve words or more list them; documents without such a line use their words' line indexes."""
    w = words(spark, sf_dir)
    lines = layout.lines_of(w).where("n_words >= 12")
    return layout.lines_or_words(lines, w).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))


@query(f"""WITH {EXPORT_SQL} SELECT doc_id, line_index::BIGINT AS line_index, "left", top, "right", bottom, mean_height, n_words, text FROM lines""")
def export_lines(spark, sf_dir):
    return longs(layout.export_lines(words(spark, sf_dir)), "line_index")


@query(f"""WITH {EXPORT_SQL} SELECT doc_id, count(*) FILTER (joined AND prev IS NOT NULL) AS n_joined, count(*) AS n_words FROM spaced GROUP BY doc_id""")
def word_spacing(spark, sf_dir):
    """How many words of a document follow without a blank."""
    first = F.row_number().over(layout.Window.partitionBy("doc_id", "line_index").orderBy("word_index")) == 1
    w = layout.spaced_words(words(spark, sf_dir)).withColumn("_first", first)
    return w.groupBy("doc_id").agg(F.count_if(~F.col("_first") & (F.col("_piece") == F.col("norm_text"))).alias("n_joined"), F.count(F.lit(1)).alias("n_words"))


@query(f"""WITH {BREAKS_SQL} SELECT doc_id, "break", count(*) AS n FROM breaks GROUP BY ALL""")
def reflow_breaks(spark, sf_dir):
    return Q.break_counts(words(spark, sf_dir))


@query(f"""WITH {BREAKS_SQL}
    SELECT doc_id, string_agg(CASE "break" WHEN 'paragraph' THEN chr(10) || chr(10) WHEN 'newline' THEN chr(10) WHEN 'space' THEN ' ' ELSE '' END || text, '' ORDER BY line_index) AS text
    FROM breaks GROUP BY doc_id""")
def reflow_text(spark, sf_dir):
    return layout.reflowed(words(spark, sf_dir))


@query(f"WITH {SCORES_SQL} SELECT doc_id, penalty::BIGINT AS penalty FROM dup")
def duplicate_token_penalty(spark, sf_dir):
    return quality.duplicate_penalty(words(spark, sf_dir))


@query(f"WITH {SCORES_SQL} SELECT doc_id, single_noise FROM base")
def single_letter_noise(spark, sf_dir):
    return words(spark, sf_dir).groupBy("doc_id").agg(F.count_if(quality.is_single_noise(F.col("norm_text"))).alias("single_noise"))


@query(f"""WITH {SCRIPTS_SQL}, s AS (
        SELECT doc_id, sum(latin)::BIGINT AS latin_chars, sum(cyrillic)::BIGINT AS cyrillic_chars, sum(digit)::BIGINT AS digit_chars, count(*) FILTER (latin > 0 AND cyrillic = 0) AS latin_words,
               count(*) FILTER (cyrillic > 0 AND latin = 0) AS cyrillic_words, count(*) FILTER (corrupted) AS corrupted_words, count(*) FILTER (ambiguous) AS ambiguous_words
        FROM judged GROUP BY doc_id)
    SELECT *, CASE WHEN latin_chars = 0 AND cyrillic_chars = 0 THEN 'none' WHEN cyrillic_chars >= latin_chars * 1.6 THEN 'cyrillic' WHEN latin_chars >= cyrillic_chars * 1.6 THEN 'latin' ELSE 'mixed' END AS dominance FROM s""")
def script_profile(spark, sf_dir):
    return quality.script_analysis(words(spark, sf_dir))


@query(f"""WITH {SCRIPTS_SQL} SELECT doc_id, line_index::BIGINT AS line_index, round(sum((latin - latin_alike) + 0.25::DOUBLE * latin_alike), 6) AS latin, round(sum((cyrillic - cyrillic_alike) + 0.25::DOUBLE * cyrillic_alike), 6) AS cyrillic
    FROM judged GROUP BY doc_id, line_index""")
def script_context(spark, sf_dir):
    found = quality.context_weights(words(spark, sf_dir), "doc_id", "line_index")
    return rounded(longs(found.select("doc_id", "line_index", "weights.latin", "weights.cyrillic"), "line_index"), "latin", "cyrillic")


@query(f"""WITH {SCORES_SQL} SELECT doc_id, n_words, alnum::BIGINT AS alnum, round(mean_confidence, 6) AS mean_confidence, known_terms::BIGINT AS known_terms, penalty::BIGINT AS penalty, round(score, 6) AS score,
        score >= 60 AND corrupted_words = 0 AND n_words >= 3 AS strong FROM scored""")
def doc_quality_score(spark, sf_dir):
    found = quality.document_scores(words(spark, sf_dir), TERMS)
    return rounded(longs(found.select("doc_id", "n_words", "alnum", "mean_confidence", "known_terms", "penalty", "score", "strong"), "alnum", "known_terms", "penalty"), "mean_confidence", "score")


@query("""WITH images AS (SELECT doc_id, n_chars FROM documents),
    plan AS (SELECT * FROM (VALUES (0, 'Fast', 'English'), (1, 'Fast', 'Russian'), (2, 'Accurate', 'English'), (3, 'Accurate', 'Russian')) p(rank, engine_id, language)),
    c AS (SELECT doc_id, rank, engine_id, language, (n_chars * 7 + rank * 13) % 29 AS score, (n_chars + rank) % 3 AS corrupted_words FROM images, plan),
    best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, engine_id, language) = 1),
    wanted AS (SELECT * FROM c WHERE language = 'Russian' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, engine_id) = 1)
    SELECT b.doc_id, CASE WHEN w.score >= b.score - 6 AND w.corrupted_words <= b.corrupted_words THEN w.engine_id ELSE b.engine_id END AS engine_id,
           CASE WHEN w.score >= b.score - 6 AND w.corrupted_words <= b.corrupted_words THEN w.language ELSE b.language END AS language,
           CASE WHEN w.score >= b.score - 6 AND w.corrupted_words <= b.corrupted_words THEN w.score ELSE b.score END AS score
    FROM best b JOIN wanted w USING (doc_id)""")
def best_candidate(spark, sf_dir):
    """Each document with every engine and language, and the one to take when Russian is asked for."""
    plan = quality.candidate_plan(documents(spark, sf_dir).select("doc_id", "n_chars"), ["Fast", "Accurate"], ["English", "Russian"])
    scores = plan.select("doc_id", "engine_id", "language", ((F.col("n_chars") * 7 + F.col("rank") * 13) % 29).alias("score"), ((F.col("n_chars") + F.col("rank")) % 3).alias("corrupted_words"))
    return quality.best_candidates(scores, "Russian").select("doc_id", "engine_id", "language", "score")


@query(rf"""WITH {WORDS_SQL},
    m AS (SELECT *, regexp_matches(norm_text, '\p{{L}}|\p{{Nd}}|[#@.\-_+]') AS textual,
                 len(regexp_extract_all(norm_text, '[\p{{So}}\p{{Sm}}\p{{Sc}}\p{{Sk}}]')) + len(regexp_extract_all(norm_text, '[\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{FE0E}}\x{{FE0F}}]')) AS symbols FROM words),
    odd AS (SELECT *, row_number() OVER () AS k FROM m WHERE NOT textual),
    near AS (SELECT DISTINCT k FROM odd a JOIN m b USING (doc_id, line_index)
             WHERE b.textual AND greatest(b.x - (a.x + a.w), a.x - (b.x + b.w)) <= 0.8 * greatest(a.h, b.h) AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= 0.4 * least(a.h, b.h)),
    r AS (SELECT doc_id, CASE WHEN NOT regexp_matches(norm_text, '\S') THEN 'blank' WHEN k IN (SELECT k FROM near) THEN 'keep'
                              WHEN greatest(w, h) <= 40 AND abs(w - h) <= 0.35 * greatest(w, h) THEN 'icon' WHEN symbols > 0 THEN 'symbol'
                              WHEN length(norm_text) > 1 AND len(list_distinct(string_split(norm_text, ''))) = 1 THEN 'repeated' ELSE 'keep' END AS reason FROM odd
          UNION ALL SELECT doc_id, 'keep' FROM m WHERE textual)
    SELECT doc_id, reason, count(*) AS n FROM r GROUP BY ALL""")
def noise_reasons(spark, sf_dir):
    """How many words of each document the noise filter keeps, or rejects and why."""
    found = noise.reject_reason(words(spark, sf_dir)).withColumn("reason", F.coalesce("reason", F.lit("keep")))
    return found.groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {WORDS_SQL}, points AS (SELECT doc_id, (doc_id * 37 % 400)::DOUBLE AS px, (doc_id * 53 % 300)::DOUBLE AS py FROM documents),
    d AS (SELECT doc_id, word_id, word_index, norm_text, sqrt(pow(greatest(x - px, px - (x + w), 0.0), 2) + pow(greatest(y - py, py - (y + h), 0.0), 2)) AS distance FROM words JOIN points USING (doc_id))
    SELECT doc_id, 0::BIGINT AS point_id, word_id, norm_text, round(distance, 6) AS distance, distance <= 12 AS is_hit FROM (SELECT *, min(distance) OVER (PARTITION BY doc_id) AS least FROM d) WHERE distance <= least + 0.001 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY word_index) = 1""")
def nearest_word(spark, sf_dir):
    points = documents(spark, sf_dir).select("doc_id", F.lit(0).cast("long").alias("point_id"), (F.col("doc_id") * 37 % 400).cast("double").alias("px"), (F.col("doc_id") * 53 % 300).cast("double").alias("py"), F.lit(12.0).alias("tolerance"))
    return rounded(Q.nearest_word(words(spark, sf_dir), points), "distance")


@query(f"""WITH {EXPORT_SQL.replace("FROM words)", "FROM words WHERE word_index BETWEEN 2 AND 4294967299)")} SELECT doc_id, string_agg(text, chr(10) ORDER BY line_index) AS text FROM lines GROUP BY doc_id""")
def range_selection_text(spark, sf_dir):
    """The text from the third word of the first line to the fourth of the second, asked for backwards."""
    ranges = documents(spark, sf_dir).select("doc_id", F.lit(LINE_STEP + 3).alias("anchor"), F.lit(2).alias("active"))
    return Q.selection_text(Q.range_selection(words(spark, sf_dir), ranges))


@query(f"WITH {WORDS_SQL} SELECT doc_id, min(word_index)::BIGINT AS first_index, max(word_index)::BIGINT AS last_index, count(*) AS n_words FROM words GROUP BY doc_id")
def full_selection(spark, sf_dir):
    return longs(Q.full_selection(words(spark, sf_dir)), "first_index", "last_index")


@query(f"WITH {WORDS_SQL} SELECT doc_id, count(*) AS n, sum(word_index)::BIGINT AS indexes FROM words WHERE length(text) >= 5 GROUP BY doc_id")
def selection_semi_join(spark, sf_dir):
    w = words(spark, sf_dir)
    return Q.selected(w, w.where("length(text) >= 5").select("doc_id", "word_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("word_index").alias("indexes"))


@query(f"WITH {WORDS_SQL}, b AS (SELECT doc_id, line_index, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS d FROM words GROUP BY ALL) SELECT doc_id, bool_or(x < 400 AND r > 240 AND y < 60 AND d > 20) AS touched FROM b GROUP BY doc_id")
def region_text(spark, sf_dir):
    return Q.touches_band(layout.lines_of(words(spark, sf_dir)), 240, 20, 400, 60)


@query()
def near_token_dictionary(spark, sf_dir):
    """Distinct tokens near a dictionary entry, which the repair changes."""
    return repair.repairs(words(spark, sf_dir), DICTIONARY).where("repaired <> norm_text").withColumnRenamed("norm_text", "token")


@query()
def near_spellings(spark, sf_dir):
    """Every different token of the documents with the nearest different word of the benchmark, one edit away at most: the dictionary is a table."""
    t = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    asked = documents(spark, sf_dir).select(t.alias("token")).where("length(token) >= 4")
    known = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(t.alias("term")).where("length(term) >= 4").distinct()
    found = repair.near_entries(asked, "token", known.select("term", F.lit(1).alias("most"), F.col("term").alias("at")), nearest=True, least=4, deepest=1)
    return found.where("entry <> token")


@query(rf"""WITH {WORDS_SQL}, w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS term FROM benchmark), terms AS (SELECT DISTINCT term FROM w WHERE length(term) >= 4),
    tokens AS (SELECT DISTINCT norm_text FROM words), c AS (SELECT norm_text, count(*) AS n FROM tokens JOIN terms ON contains(lower(norm_text), term) GROUP BY ALL)
    SELECT doc_id, sum(n)::BIGINT AS known_terms FROM words JOIN c USING (norm_text) GROUP BY doc_id""")
def known_terms(spark, sf_dir):
    """How many of the benchmark's words the documents' words hold: the terms are a table."""
    t = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    terms = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(t.alias("term")).where("length(term) >= 4")
    w = words(spark, sf_dir).select("doc_id", "norm_text")
    return w.join(quality.term_counts(w, terms), "norm_text").groupBy("doc_id").agg(F.sum("n_terms").alias("known_terms"))


@query()
def program_name_repair(spark, sf_dir):
    """Every different token read as a damaged program name, put right by the names that conversations mention."""
    t = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    names = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(t.alias("name")).where("length(name) BETWEEN 4 AND 12")
    damaged = F.concat(F.translate(F.regexp_replace("norm_text", r"[^\p{L}\p{Nd}_-]", ""), "oa", "оа"), F.lit(".ехе"))
    tokens = words(spark, sf_dir).select("norm_text").distinct().select(damaged.alias("norm_text"))
    return repair.program_names(tokens, names, most=1)


@query(rf"""WITH {WORDS_SQL}, r AS (SELECT doc_id, word_id, line_index, norm_text, x + ((line_index + word_index) % 3 - 1) * 5 AS x, y, w, h FROM words),
    p AS (SELECT a.doc_id, a.word_id AS left_id, b.word_id AS right_id,
                 greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / greatest(1.0, least(a.w * a.h, b.w * b.h)) AS overlap,
                 greatest(abs(a.x + a.w / 2 - b.x - b.w / 2), abs(a.y - b.y)) <= 0.6 * 18 AS near,
                 upper(regexp_replace(a.norm_text, '[^\p{{L}}\p{{Nd}}]', '', 'g')) AS f, upper(regexp_replace(b.norm_text, '[^\p{{L}}\p{{Nd}}]', '', 'g')) AS g
          FROM words a JOIN r b ON a.doc_id = b.doc_id AND a.line_index = b.line_index AND a.x <= b.x + b.w AND b.x <= a.x + a.w)
    SELECT doc_id, count(*) AS n_pairs, round(sum(greatest(overlap, 1e-6)), 6) AS overlap FROM p
    WHERE overlap >= 0.35 OR ((overlap >= 0.15 OR near) AND f <> '' AND (f = g OR (length(f) >= 4 AND length(g) >= 4 AND abs(length(f) - length(g)) <= 2 AND (contains(f, g) OR contains(g, f))))) GROUP BY doc_id""")
def overlap_pairs(spark, sf_dir):
    """Words that visibly coincide with those of a shifted copy of the layout."""
    w = words(spark, sf_dir)
    shifted = w.withColumn("x", F.col("x") + ((F.col("line_index") + F.col("word_index")) % 3 - 1) * 5)
    return rounded(fusion.overlapping(w, shifted).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("overlap").alias("overlap")), "overlap")


@query(f"""WITH {WORDS_SQL}, inked AS (SELECT doc_id, line_index AS y FROM l1 WHERE length(line) >= 40),
    marked AS (SELECT *, (y - lag(y) OVER (PARTITION BY doc_id ORDER BY y) > 3)::INT AS fresh FROM inked),
    runs AS (SELECT *, sum(coalesce(fresh, 0)) OVER (PARTITION BY doc_id ORDER BY y) AS run FROM marked)
    SELECT doc_id, min(y)::BIGINT AS top, max(y)::BIGINT AS bottom FROM runs GROUP BY doc_id, run""")
def row_runs(spark, sf_dir):
    """Lines as rows of ink: runs of rows with 40 characters, bridging two shorter ones."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("y", "_line")).select("doc_id", "y", F.length("_line").alias("ink"))
    return longs(layout.row_runs(rows, least=40), "top", "bottom")


@query(f"""WITH {WORDS_SQL}, b AS (SELECT doc_id, line_index, min(y) AS top, max(y + h) AS bottom FROM words GROUP BY ALL HAVING count(*) >= 4),
    m AS (SELECT *, (top > max(bottom) OVER (PARTITION BY doc_id ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8)::INT AS fresh FROM b),
    r AS (SELECT *, sum(coalesce(fresh, 0)) OVER (PARTITION BY doc_id ORDER BY top, bottom ROWS UNBOUNDED PRECEDING) AS region FROM m)
    SELECT doc_id, min(top) AS top, max(bottom) AS bottom FROM r GROUP BY doc_id, region""")
def merge_regions(spark, sf_dir):
    lines = layout.lines_of(words(spark, sf_dir)).where("n_words >= 4")
    return layout.merged_regions(lines.select("doc_id", F.col("y").alias("top"), (F.col("y") + F.col("h")).alias("bottom")), gap=8.0)


@query("""WITH i AS (SELECT doc_id, n_chars % 2000 AS image_h FROM documents), b AS (SELECT doc_id, image_h, unnest(range(0, greatest(image_h - 25, 0) + 1, 136)) AS top FROM i WHERE image_h > 0)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY top) - 1)::BIGINT AS band, top::BIGINT AS top, least(top + 160, image_h)::BIGINT AS bottom FROM b""")
def fallback_bands(spark, sf_dir):
    return longs(layout.bands(documents(spark, sf_dir).select("doc_id", (F.col("n_chars") % 2000).cast("int").alias("image_h"))), "band", "top", "bottom")


STATS_SQL = """s AS (SELECT doc_id, source AS path, (300 + n_chars % 1500)::INT AS pixel_w, (200 + n_chars * 3 % 1700)::INT AS pixel_h, (n_chars * 7 % 256)::DOUBLE AS avg_luminance, (n_chars * 5 % 200)::INT AS contrast_range, (n_chars % 100) / 400.0::DOUBLE AS edge_density FROM documents),
    f AS (SELECT *, avg_luminance < 110 AS dark, contrast_range < 60 AS low_contrast, greatest(pixel_w, pixel_h) < 900 AND edge_density > 0.12 AS small_text, pixel_w < 700 AND pixel_h > pixel_w AS chat_like FROM s)"""


def stats_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    stats = documents(spark, sf_dir).select("doc_id", F.col("source").alias("path"), (300 + n % 1500).cast("int").alias("pixel_w"), (200 + n * 3 % 1700).cast("int").alias("pixel_h"), (n * 7 % 256).cast("double").alias("avg_luminance"), (n * 5 % 200).cast("int").alias("contrast_range"), (n % 100 / F.lit(400.0)).alias("edge_density"))
    return choice.image_flags(stats)


@query(f"""WITH {STATS_SQL}, m AS (SELECT *, (['Auto','Fast','Accurate'])[doc_id % 3 + 1] AS mode, (['English','Russian'])[doc_id % 2 + 1] AS language FROM f)
    SELECT doc_id, dark, low_contrast, small_text, chat_like,
           CASE WHEN mode = 'Accurate' OR language = 'Russian' THEN 'Accurate' WHEN mode = 'Fast' THEN 'Fast' WHEN dark OR low_contrast OR small_text THEN 'Accurate' ELSE 'Fast' END AS engine_id FROM m""")
def engine_choice(spark, sf_dir):
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    found = stats_of(spark, sf_dir).withColumn("engine_id", choice.engine_choice(pick("Auto", "Fast", "Accurate"), pick("English", "Russian"), F.col("path")))
    return found.select("doc_id", "dark", "low_contrast", "small_text", "chat_like", "engine_id")


@query(f"""WITH {STATS_SQL} SELECT doc_id, round(least(CASE WHEN small_text AND greatest(pixel_w, pixel_h) < 600 THEN 3.0 WHEN small_text OR greatest(pixel_w, pixel_h) < 900 THEN 2.0 ELSE 1.0 END, 4800.0 / greatest(pixel_w, pixel_h, 1)), 6)::DOUBLE AS scale,
        dark AS invert, low_contrast OR dark AS stretch_contrast, low_contrast AND NOT chat_like AS binarise, small_text AS sharpen, chat_like AS sparse_pass,
        ((1 + dark::INT + (low_contrast OR dark)::INT + (low_contrast AND NOT chat_like)::INT + small_text::INT) * (1 + chat_like::INT))::BIGINT AS n_variants FROM f""")
def preprocessing_plan(spark, sf_dir):
    """Each image's plan, and how many variants and modes it asks for."""
    plans = stats_of(spark, sf_dir).withColumns(choice.preprocessing_plan())
    counts = choice.variants(plans).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_variants"))
    return rounded(plans.join(counts, "doc_id").select("doc_id", "scale", "invert", "stretch_contrast", "binarise", "sharpen", "sparse_pass", "n_variants"), "scale")


@query("""WITH s AS (SELECT doc_id, (['Auto','Fast','Accurate','?'])[doc_id % 4 + 1] AS mode, (['English','Russian','EnglishRussian','Auto','?'])[doc_id % 5 + 1] AS language FROM documents),
    n AS (SELECT doc_id, mode, CASE language WHEN 'EnglishRussian' THEN 'Russian' WHEN 'Russian' THEN 'Russian' ELSE 'English' END AS language FROM s)
    SELECT doc_id, language, CASE WHEN language = 'Russian' THEN 'Accurate' WHEN mode = '?' THEN 'Fast' ELSE mode END AS mode FROM n""")
def settings_normalised(spark, sf_dir):
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in settings.settings_columns(pick("Auto", "Fast", "Accurate", "?"), pick("English", "Russian", "EnglishRussian", "Auto", "?")).items()])


@query("""WITH v AS (SELECT doc_id, 200.0 + doc_id % 700 AS vw, 300.0 + doc_id % 500 AS vh, 100.0 + n_chars % 3000 AS iw, 100.0 + n_chars % 1100 AS ih, doc_id % 200 + 0.5 AS anchor FROM documents),
    z AS (SELECT *, least(vw / iw, vh / ih)::DOUBLE AS zoom FROM v)
    SELECT doc_id, round(zoom, 6) AS zoom, round(least(greatest(zoom * 1.25, 0.05), 20.0), 6) AS zoomed, round(anchor - (anchor - 10.0) / zoom * least(greatest(zoom * 1.25, 0.05), 20.0), 6) AS pan FROM z""")
def viewport_zoom(spark, sf_dir):
    """Fit zoom of an image in a view, and zoom and pan after zooming about an anchor."""
    d, n = F.col("doc_id"), F.col("n_chars")
    views = documents(spark, sf_dir).select("doc_id", G.fit_zoom(200.0 + d % 700, 300.0 + d % 500, 100.0 + n % 3000, 100.0 + n % 1100).alias("zoom"), (d % 200 + 0.5).alias("_anchor"))
    zoom, pan = G.zoomed_pan(F.col("_anchor"), F.col("zoom"), F.lit(10.0), F.lit(1.25))
    return rounded(views.select("doc_id", "zoom", zoom.alias("zoomed"), pan.alias("pan")), "zoom", "zoomed", "pan")


@query("""SELECT doc_id, CASE WHEN sqrt(pow(doc_id % 7, 2) + pow(n_chars % 5, 2)) < 4 THEN 'click' WHEN doc_id % 3 = 0 OR n_chars % 2 = 1 THEN 'pan' ELSE 'select' END AS intent,
    floor(least(doc_id % 90, 60 + doc_id % 9) * 1.5)::INT AS px, (ceil(greatest(doc_id % 90, 60 + doc_id % 9) * 1.5) - floor(least(doc_id % 90, 60 + doc_id % 9) * 1.5))::INT AS pw, 40 <= n_chars % 100 AS large FROM documents""")
def pointer_intent(spark, sf_dir):
    """Click, pan or selection of a drag, and the pixel columns of a selected region."""
    d, n = F.col("doc_id"), F.col("n_chars")
    box = G.pixel_box((d % 90).cast("double"), F.lit(0.0), (60 + d % 9).cast("double"), F.lit(30.0), F.lit(100.0), F.lit(100.0), F.lit(1.5), F.lit(1.5))
    found = documents(spark, sf_dir).select("doc_id", G.drag_intent((d % 7).cast("double"), (n % 5).cast("double"), n % 2 == 0, d % 3 == 0).alias("intent"), *box, G.large_enough(n % 100, F.lit(40), 40).alias("large"))
    return found.select("doc_id", "intent", "px", "pw", "large")


@query(f"WITH {WORDS_SQL} SELECT doc_id, round(coalesce(avg(confidence), 70.0), 6) AS mean_confidence FROM words GROUP BY doc_id")
def mean_confidence(spark, sf_dir):
    return rounded(words(spark, sf_dir).groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(quality.DOCUMENT_CONFIDENCE)).alias("mean_confidence")), "mean_confidence")


@query(rf"""WITH {WORDS_SQL}, r AS (SELECT word_id, doc_id, unnest(regexp_extract_all(norm_text, '[\d.]*\d[\d.]*')) AS run, unnest(range(len(regexp_extract_all(norm_text, '[\d.]*\d[\d.]*')))) AS k FROM words),
    c AS (SELECT *, regexp_replace(run, '^\.+|\.+$', '', 'g') AS core FROM r)
    SELECT doc_id, word_id, core AS run FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, word_id ORDER BY length(core) DESC, k) = 1""")
def digit_runs(spark, sf_dir):
    """The longest digit-and-dot run of every word that has a digit."""
    return words(spark, sf_dir).select("doc_id", "word_id", T.longest_digit_run(F.col("norm_text")).alias("run")).where("run IS NOT NULL")


@query("""WITH c(language, key, text) AS (VALUES ('Russian', 'src1', 'один'), ('English', 'src1', 'one'), ('English', 'src2', 'two')), k AS (SELECT DISTINCT source AS key FROM documents)
    SELECT key, coalesce(a.text, b.text, key) AS text FROM k LEFT JOIN (SELECT key, text FROM c WHERE language = 'Russian') a USING (key) LEFT JOIN (SELECT key, text FROM c WHERE language = 'English') b USING (key)""")
def interface_texts(spark, sf_dir):
    catalogue = spark.createDataFrame([("Russian", "src1", "один"), ("English", "src1", "one"), ("English", "src2", "two")], "language string, key string, text string")
    return settings.interface_texts(documents(spark, sf_dir).select(F.col("source").alias("key")).distinct(), catalogue, "Russian")


@query()
def fragment_merge(spark, sf_dir):
    """Lines of words spread so that some nearly touch, merged."""
    w = words(spark, sf_dir)
    return layout.merged_fragments(w.withColumn("x", F.when(F.col("word_index") % 4 == 1, F.col("x") - 160 + F.lag("w").over(layout.Window.partitionBy("doc_id", "line_index").orderBy("word_index"))).otherwise(F.col("x"))))


@query()
def rect_merge(spark, sf_dir):
    return layout.merged_rects(words(spark, sf_dir))


@query()
def fused_words(spark, sf_dir):
    """Two jittered readings of every document fused."""
    w = words(spark, sf_dir)
    return fusion.fused([("English", w), ("Russian", jittered(w, 1))])


def routed_input(spark, sf_dir):
    """Two readings of every document, and the route of each line by letters and by the sum of its words' confidences."""
    english = words(spark, sf_dir)
    russian = jittered(english, 1)
    t = F.col("norm_text")
    # One grouping of both readings, each of which has every line.
    both = english.withColumn("_n", F.lit("e")).unionByName(russian.withColumn("_n", F.lit("r")))
    of = lambda n, x: F.sum(F.when(F.col("_n") == n, x))
    met = both.groupBy("doc_id", "line_index").agg(of("e", F.col("confidence")).alias("e"), of("r", F.col("confidence")).alias("r"), of("r", T.count_of(t, S.LATIN)).alias("r_latin"), of("r", T.count_of(t, S.CYRILLIC)).alias("r_cyrillic"))
    route = choice.line_route(F.col("r_latin"), F.col("r_cyrillic"), F.col("e"), F.col("r"), margin=1.05)
    return [("English", english), ("Russian", russian)], met.select("doc_id", "line_index", route.alias("route"))


@query()
def routed_words(spark, sf_dir):
    """Lines of every document taken from one of two readings or fused, as their routes say."""
    return fusion.routed(*routed_input(spark, sf_dir))


@query()
def coverage_merge(spark, sf_dir):
    w = words(spark, sf_dir)
    first = jittered(w, 1).withColumns({"candidate": F.lit(0), "candidate_score": F.lit(80.0)})
    second = jittered(w, 2).withColumns({"candidate": F.lit(1), "candidate_score": F.lit(70.0)})
    return fusion.coverage_merged(first.unionByName(second))


@query()
def corrected_words(spark, sf_dir):
    """Jittered words after dictionary and script correction."""
    return repair.corrected(jittered(words(spark, sf_dir), 1), DICTIONARY)


@query()
def postprocessed_words(spark, sf_dir):
    """The whole chain: correct, merge fragments, noise out, correct again."""
    return repair.postprocessed(jittered(words(spark, sf_dir), 1), DICTIONARY)[0]


@query()
def postprocessed_analysis(spark, sf_dir):
    return repair.postprocessed(words(spark, sf_dir), DICTIONARY)[1]


def byte_images(spark, sf_dir):
    """Images made of the texts' own bytes, 16 pixels wide; a text under 64 bytes, or null, is an image without rows."""
    text = F.coalesce("text", F.lit(""))
    return documents(spark, sf_dir).select("doc_id", F.lit(16).alias("width"), F.floor(F.octet_length(text) / 64).cast("int").alias("height"), F.lit(64).alias("stride"), F.encode(text, "utf-8").alias("pixels"))


@query()
def image_statistics(spark, sf_dir):
    """Statistics of the byte images of all texts."""
    rows = byte_images(spark, sf_dir)
    return rounded(images.image_stats(rows), "avg_luminance", "edge_density")


@query()
def ink_row_runs(spark, sf_dir):
    """Row runs of the same images' ink."""
    rows = byte_images(spark, sf_dir)
    return layout.row_runs(images.ink_histogram(rows), least=5)


@query()
def text_regions(spark, sf_dir):
    """Lines of text in the byte images of all texts, and bands where there is none."""
    return images.text_regions(byte_images(spark, sf_dir), images.Segmentation(row_ink=4, gap=1, column_share=0.2, pad=1, close=0.0, band=12, shared=3))


def evaluated(docs: DataFrame, engine: str, mode: str) -> DataFrame:
    """A reading of documents by an engine: Fast sees the words that are sure and fails where fewer than three are, Accurate sees all;
    in Russian, what looks Cyrillic is read so."""
    t = F.col("norm_text")
    w = synthetic_words(dealt(docs), step=160)
    if engine == "Fast":
        w = w.where("confidence >= 75")
    if mode != "English":
        alike = S.looks_cyrillic(t) if mode == "EnglishRussian" else t.rlike(f"^{T.char_class(S.LATIN_LOOKS)}+$")
        w = w.withColumn("norm_text", F.when(alike, S.to_cyrillic(t)).otherwise(t))
    found = quality.language_scores(w, [mode])
    found = found.where(F.col("n_words") >= 3) if engine == "Fast" else found
    return found.select("doc_id", F.round("mode_score", 6).alias("score"), ((F.col("mode_score") >= STRONG) & (F.col("corrupted_words") == 0)).alias("strong"), "latin", "cyrillic", "corrupted_words")


STRONG = 110.0
MODES, ENGINES = ["English", "EnglishRussian", "English", "Russian"], ["Fast", "Accurate"]


@query()
def staged_choice(spark, sf_dir):
    """Each document read in stages until a reading is strong, and the reading to take when none is asked for."""
    found = staging.staged_candidates(documents(spark, sf_dir).select("doc_id", "text"), MODES, ENGINES, evaluated)
    return staging.chosen_candidates(found, "Auto")


@query(rf"""WITH {SCRIPTS_SQL}
    SELECT doc_id, CASE WHEN latin > cyrillic THEN 'latin' WHEN cyrillic > latin THEN 'cyrillic' WHEN latin = 0 THEN 'none' ELSE 'mixed' END AS script, count(*) AS n FROM judged GROUP BY ALL""")
def token_scripts(spark, sf_dir):
    return words(spark, sf_dir).withColumn("script", S.token_script(F.col("norm_text"))).groupBy("doc_id", "script").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH {WORDS_SQL}, tokens AS (SELECT doc_id, translate(lower(norm_text), '{T.DIGIT_LOOKS[0]}', '{T.DIGIT_LOOKS[1]}') AS digit_fold,
        regexp_replace(translate(lower(translate(norm_text, '{S.CYRILLIC_LOOKS}', '{S.LATIN_LOOKS}')), '0135', 'olss'), '[^a-z]', '', 'g') AS skeleton FROM words)
    SELECT doc_id, count(DISTINCT digit_fold) AS folds, count(DISTINCT skeleton) AS skeletons, sum(length(skeleton))::BIGINT AS letters FROM tokens GROUP BY doc_id""")
def token_skeletons(spark, sf_dir):
    """Distinct digit folds and look-alike skeletons of each document's tokens."""
    t = F.col("norm_text")
    tokens = words(spark, sf_dir).groupBy("doc_id", "norm_text").agg(F.count(F.lit(1)).alias("_n"))
    tokens = tokens.select("doc_id", "_n", T.digit_fold(t).alias("_fold"), S.skeleton(t).alias("_skeleton"))
    kinds = F.array(F.struct(F.lit("fold").alias("_kind"), F.col("_fold").alias("_form"), F.lit(0).cast("long").alias("_letters")), F.struct(F.lit("skeleton").alias("_kind"), F.col("_skeleton").alias("_form"), (F.length("_skeleton") * F.col("_n")).alias("_letters")))
    forms = tokens.select("doc_id", F.inline(kinds)).groupBy("doc_id", "_kind", "_form").agg(F.sum("_letters").alias("_letters"))
    return forms.groupBy("doc_id").agg(F.count_if(F.col("_kind") == "fold").alias("folds"), F.count_if(F.col("_kind") == "skeleton").alias("skeletons"), F.sum("_letters").alias("letters"))


PAGES_SQL = SCRIPTS_SQL + r""",
    readings AS (SELECT *, 0 AS rank FROM judged UNION ALL SELECT *, 1 FROM judged WHERE confidence >= 75),
    pages AS (
        SELECT doc_id, rank, count(*) AS n_words, sum(len(regexp_extract_all(norm_text, '\p{L}')) + digit) AS alnum, avg(confidence) AS mean_confidence, count(*) FILTER (corrupted) AS corrupted
        FROM readings GROUP BY ALL),
    scores AS (SELECT *, mean_confidence * 0.5::DOUBLE + ln(1 + alnum::DOUBLE) * 8 + least(n_words, 200) * 0.05::DOUBLE - corrupted * 4 AS score FROM pages)
"""


def page_readings(spark, sf_dir):
    """Two readings of each page, all words and the surer ones, with their page scores."""
    t = F.col("norm_text")
    w = words(spark, sf_dir).withColumn("rank", F.explode(F.when(F.col("confidence") >= 75, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    pages = w.groupBy("doc_id", "rank").agg(F.count(F.lit(1)).alias("n_words"), F.sum(T.letters(t) + T.digits(t)).alias("alnum"), F.avg("confidence").alias("mean_confidence"), F.count_if(S.is_corrupted(t, c=S.analysis_counts(t))).alias("corrupted"))
    return pages.withColumn("score", choice.page_score(F.col("n_words"), F.col("mean_confidence"), F.col("alnum"), F.col("corrupted")))


@query(rf"WITH {PAGES_SQL} SELECT doc_id, rank::BIGINT AS rank, round(score, 6) AS score FROM scores")
def page_scores(spark, sf_dir):
    return rounded(longs(page_readings(spark, sf_dir).select("doc_id", "rank", "score"), "rank"), "score")


@query(rf"""WITH {PAGES_SQL} SELECT a.doc_id, b.score > a.score OR (b.score >= 0.95 * a.score AND b.n_words > a.n_words * 1.2) AS better
    FROM scores a JOIN scores b ON a.doc_id = b.doc_id AND a.rank = 0 AND b.rank = 1""")
def better_results(spark, sf_dir):
    """Whether the reading of the surer words alone replaces that of all words."""
    both = page_readings(spark, sf_dir).groupBy("doc_id").pivot("rank", [0, 1]).agg(F.first("score").alias("score"), F.first("n_words").alias("n"))
    return both.where("`1_n` IS NOT NULL").select("doc_id", choice.better_result(F.col("1_score"), F.col("0_score"), F.col("1_n"), F.col("0_n")).alias("better"))


@query(rf"""WITH {SCRIPTS_SQL}, lines AS (
        SELECT doc_id, line_index, sum(latin) AS latin, sum(cyrillic) AS cyrillic, sum(CASE WHEN latin > 0 THEN confidence ELSE 20 END) AS english, sum(CASE WHEN cyrillic > 0 THEN confidence ELSE 20 END) AS russian FROM judged GROUP BY ALL)
    SELECT doc_id, CASE WHEN cyrillic = 0 AND latin > 0 AND english >= russian THEN 'English' WHEN latin = 0 AND cyrillic > 0 AND russian >= english THEN 'Russian'
        WHEN english > russian * 1.15::DOUBLE THEN 'English' WHEN russian > english * 1.15::DOUBLE THEN 'Russian' ELSE 'Fused' END AS route, count(*) AS n FROM lines GROUP BY ALL""")
def line_routes(spark, sf_dir):
    """How many lines of each document go to which reading."""
    w, c = S.with_counts(words(spark, sf_dir)), S.counts_in()
    score = lambda n: F.sum(F.when(n > 0, F.col("confidence")).otherwise(20.0))
    lines = w.groupBy("doc_id", "line_index").agg(F.sum(c["latin"]).alias("latin"), F.sum(c["cyrillic"]).alias("cyrillic"), score(c["latin"]).alias("english"), score(c["cyrillic"]).alias("russian"))
    route = choice.line_route(F.col("latin"), F.col("cyrillic"), F.col("english"), F.col("russian"))
    return lines.select("doc_id", route.alias("route")).groupBy("doc_id", "route").agg(F.count(F.lit(1)).alias("n"))


@query()
def corrected_counts(spark, sf_dir):
    """How many words of each document the correction changes."""
    return repair.correction_counts(repair.corrected(jittered(words(spark, sf_dir), 1), DICTIONARY))


@query("SELECT strftime(ts, '%Y%m%d-%H%M%S') AS stamp, count(*) AS n FROM (SELECT TIMESTAMP '2024-01-02 03:04:05' + to_seconds(doc_id * 3607) AS ts FROM documents) GROUP BY ALL")
def file_stamps(spark, sf_dir):
    """Stamps for file names."""
    at = F.timestamp_seconds(F.lit(1_704_164_645) + F.col("doc_id") * 3607)
    return documents(spark, sf_dir).select(T.stamp(at).alias("stamp")).groupBy("stamp").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH {SCORES_SQL}, letters AS (SELECT doc_id, sum(latin)::BIGINT AS l, sum(cyrillic)::BIGINT AS c FROM judged GROUP BY doc_id),
    modes AS (SELECT s.doc_id, m.mode, score, l, c, CASE m.mode WHEN 'Russian' THEN c WHEN 'EnglishRussian' THEN 2 * least(l, c) ELSE l END AS own,
        CASE WHEN l = 0 AND c = 0 THEN 'none' WHEN c >= l * 1.6::DOUBLE THEN 'cyrillic' WHEN l >= c * 1.6::DOUBLE THEN 'latin' ELSE 'mixed' END AS prevails
        FROM scored s JOIN letters USING (doc_id), (VALUES ('English'), ('Russian'), ('EnglishRussian')) m(mode))
    SELECT doc_id, mode, round(greatest(0.0, score + 12.0::DOUBLE * own / greatest(l + c, 1)
        + CASE WHEN prevails = CASE mode WHEN 'Russian' THEN 'cyrillic' WHEN 'EnglishRussian' THEN 'mixed' ELSE 'latin' END THEN 5 ELSE 0 END), 6) AS mode_score,
        CASE prevails WHEN 'cyrillic' THEN 'Russian' WHEN 'mixed' THEN 'EnglishRussian' ELSE 'English' END AS suggested_language FROM modes""")
def mode_scores(spark, sf_dir):
    """Every document's score under each language mode; a mode asked for twice counts once."""
    found = quality.language_scores(words(spark, sf_dir), ["English", "Russian", "EnglishRussian", "English"], TERMS)
    return rounded(found.select("doc_id", "mode", "mode_score", "suggested_language"), "mode_score")
