"""Ad-hoc queries on recognised documents: nearest word, range and full selection, text of a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.geometry import Box
from pagemill.operators.layout import export_lines, line_breaks, ordered_text

#: Words no further from the nearest one than this are as near.
SAME = 0.001


def nearest_word(words: DataFrame, points: DataFrame) -> DataFrame:
    """Of each point (doc_id, point_id, px, py, tolerance) the nearest word and whether it is within tolerance.

    Of the words that are no more than SAME further away than the nearest one the lowest word index is taken. Points
    without a word in their document have no row. Words meet points by document; the rest stays with the document.
    """
    b = Box.of()
    met = words.join(points, "doc_id").withColumn("distance", b.distance(F.col("px"), F.col("py")))
    least = F.min("distance").over(Window.partitionBy("doc_id", "point_id"))
    near = met.withColumn("_least", least).where(F.col("distance") <= F.col("_least") + SAME)
    best = near.groupBy("doc_id", "point_id").agg(F.min(F.struct("word_index", "distance", "word_id", "tolerance", "norm_text")).alias("b"))
    return best.select("doc_id", "point_id", F.col("b.word_id").alias("word_id"), F.col("b.norm_text").alias("norm_text"), F.col("b.distance").alias("distance"), (F.col("b.distance") <= F.col("b.tolerance")).alias("is_hit"))


def range_selection(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """Words between two indexes, in either order and inclusive, of each range (doc_id, anchor, active); a range without words has no row."""
    return words.join(ranges, "doc_id").where(F.col("word_index").between(F.least("anchor", "active"), F.greatest("anchor", "active"))).drop("anchor", "active")


def full_selection(words: DataFrame) -> DataFrame:
    """(doc_id, first_index, last_index, n_words) of each document with words."""
    return words.groupBy("doc_id").agg(F.min("word_index").alias("first_index"), F.max("word_index").alias("last_index"), F.count(F.lit(1)).alias("n_words"))


def selected(words: DataFrame, ids: DataFrame) -> DataFrame:
    """Words whose (doc_id, word_id) is selected."""
    return words.join(ids, ["doc_id", "word_id"], "left_semi")


def selection_text(words: DataFrame) -> DataFrame:
    """(doc_id, text) of selected words: words spaced, lines on lines of their own."""
    return export_lines(words).groupBy("doc_id").agg(ordered_text("line_index", "text", "\n").alias("text"))


def touches_band(lines: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """(doc_id, touched): whether any line meets a band."""
    b = Box.of()
    return lines.groupBy("doc_id").agg(F.bool_or((b.x < right) & (b.right > left) & (b.y < bottom) & (b.bottom > top)).alias("touched"))


def break_counts(words: DataFrame) -> DataFrame:
    """(doc_id, break, n): how lines of each document follow each other."""
    return line_breaks(export_lines(words)).groupBy("doc_id", "break").agg(F.count(F.lit(1)).alias("n"))


def best_per_document(candidates: DataFrame, score: str, *tie: str) -> DataFrame:
    """The row with the highest score of each document; of equal ones the first by ``tie``."""
    w = Window.partitionBy("doc_id").orderBy(F.col(score).desc(), *tie)
    return candidates.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
