"""Sources of layout tables.

words: doc_id, word_id, word_index, line_index, text, norm_text, x, y, w, h, confidence (null if the recogniser gives none)
lines: doc_id, line_id, line_index, text, x, y, w, h, word_ids
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.geometry import Box
from pagemill.functions.text import collapsed, is_blank

#: Word indexes of a line begin at this multiple of its index; a line has fewer tokens, as a text has fewer bytes.
LINE_STEP = 1 << 32
#: Bytes of text in a part of dealt documents; their words take some fifty times that while a task sorts them.
PART_TEXT = 4 << 20
IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp", "webp")
WORDS = "doc_id string, word_id string, word_index int, line_index int, text string, norm_text string, x double, y double, w double, h double, confidence double"


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files under a path: (path, modificationTime, length, content); other types are left out whatever their case."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_TYPES))


def recognised(images: DataFrame, recogniser: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Words that a recogniser plug-in returns for image rows; it takes and gives batches, in the schema WORDS."""
    return images.mapInPandas(recogniser, WORDS)


def from_results(results: DataFrame, sx: float = 1.0, sy: float = 1.0) -> DataFrame:
    """Words from nested recogniser results (doc_id, lines array<struct<words array<struct<text,x,y,w,h,confidence>>>>).

    Boxes are divided by the scale of the raster; blank words go; the rest are numbered densely, lines as they come.
    """
    lines = results.select("doc_id", F.posexplode("lines").alias("_line", "_content"))
    found = lines.select("doc_id", "_line", F.posexplode("_content.words").alias("_at", "_word")).select("doc_id", "_line", "_at", "_word.*")
    found = found.withColumn("norm_text", collapsed(F.col("text"))).where(~is_blank(F.col("norm_text")))
    found = found.select("doc_id", "_line", "_at", "text", "norm_text", *Box.of().scaled(F.lit(sx), F.lit(sy)).columns(), F.col("confidence").cast("double").alias("confidence"))
    return numbered(found, "_line", "_at")


def numbered(words: DataFrame, line: str, at: str) -> DataFrame:
    """Dense 0-based word and line indexes in the order of (line, at), and ids made from them."""
    order = Window.partitionBy("doc_id").orderBy(line, at)
    words = words.withColumn("word_index", F.row_number().over(order) - 1).withColumn("line_index", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(line)) - 1)
    return words.select("doc_id", F.concat_ws("-", F.lit("w"), "word_index").alias("word_id"), "word_index", "line_index", "text", "norm_text", "x", "y", "w", "h", "confidence")


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART_TEXT) -> DataFrame:
    """(id, text) dealt by id into parts of about ``part`` bytes of text, one a core at least: one pass over lengths alone sizes them.

    Words made from it are where their document is, so groupings, windows and joins by document need no exchange of words,
    which are many times their text.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return docs.select(id_col, text_col).repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // part)), id_col)


def synthetic_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: int = 24, char: int = 8, least: int = 10, height: int = 18, leading: int = 24) -> DataFrame:
    """A layout made from plain text: a line per line break, a word per blank-separated token.

    Word i of a line stands at x = step * i and is ``char`` wide per character, ``least`` at least; line j stands at
    y = leading * j. Confidence is 60 to 99, made from length and place. Empty tokens are left out, null texts have none.
    Two explodes of one scan, no shuffle; word_index, a long, orders a document's words but leaves gaps.
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_index", "_line"))
    words = lines.select("doc_id", "line_index", F.posexplode(F.split("_line", " ")).alias("_at", "text")).where(F.col("text") != "")
    return words.select(
        "doc_id",
        F.concat_ws("-", F.lit("w"), "line_index", "_at").alias("word_id"),
        (F.col("line_index").cast("long") * LINE_STEP + F.col("_at")).alias("word_index"),
        "line_index",
        "text",
        collapsed(F.col("text")).alias("norm_text"),
        (F.col("_at") * step).cast("double").alias("x"),
        (F.col("line_index") * leading).cast("double").alias("y"),
        F.greatest(F.lit(least), F.length("text") * char).cast("double").alias("w"),
        F.lit(height).cast("double").alias("h"),
        (60 + (F.length("text") * 7 + F.col("_at") * 3) % 40).cast("double").alias("confidence"),
    )


def jittered(words: DataFrame, branch: int, shift: float = 1.5) -> DataFrame:
    """A second recogniser's view of the same words: boxes moved a little and some tokens damaged, by hashes alone."""
    draw = lambda salt: F.crc32(F.concat_ws("|", F.lit(f"{branch}{salt}"), "doc_id", "word_id"))
    moved = lambda salt: (draw(salt) % 3 - 1) * shift
    text = F.when(draw("t") % 7 == 0, F.concat(F.expr("substring(text, 1, length(text) - 1)"), F.lit("l"))).otherwise(F.col("text"))
    return words.withColumns({"x": F.col("x") + moved("x"), "y": F.col("y") + moved("y"), "text": text, "norm_text": collapsed(text), "confidence": (55 + draw("c") % 45).cast("double"), "word_id": F.concat_ws("-", F.lit(f"b{branch}"), "word_id")})
