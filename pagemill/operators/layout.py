"""Lines, boxes, reflow and merging on words and lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.geometry import Box

#: Vertical gap between lines over their mean height: a paragraph beyond the first, a line break from the second.
PARAGRAPH, LINE_BREAK = 1.2, 0.8


def ordered_text(order: str | Column, text: str, sep: str) -> Column:
    """Aggregate: texts joined in an order."""
    order = F.col(order) if isinstance(order, str) else order
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(text).alias("t")))), lambda s: s["t"]), sep)


def union_box() -> list[Column]:
    """Aggregates: the box around all boxes."""
    b = Box.of()
    return [F.min("x").alias("x"), F.min("y").alias("y"), (F.max(b.right) - F.min("x")).alias("w"), (F.max(b.bottom) - F.min("y")).alias("h")]


def lines_of(words: DataFrame) -> DataFrame:
    """Lines rebuilt from words by line index: box, text in word order, word ids; one map-side combined grouping."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("word_index", "word_id"))), lambda s: s["word_id"])
    return words.groupBy("doc_id", "line_index").agg(*union_box(), F.count(F.lit(1)).alias("n_words"), ordered_text("word_index", "text", " ").alias("text"), ids.alias("word_ids")).withColumn("line_id", F.concat_ws("-", F.lit("l"), "line_index"))


def with_lists(lines: DataFrame, words: DataFrame) -> DataFrame:
    """``words`` with _lines, array<struct<_line>>: the lines that list each one. A window over both by word, so that words dealt by document stay where they are."""
    listed = lines.select("doc_id", F.col("line_index").alias("_line"), F.explode("word_ids").alias("word_id")).where("doc_id IS NOT NULL AND word_id IS NOT NULL")
    both = words.withColumn("_word", F.lit(True)).unionByName(listed, allowMissingColumns=True)
    found = F.collect_list(F.when(F.col("_word").isNull(), F.struct("_line"))).over(Window.partitionBy("doc_id", "word_id"))
    return both.withColumn("_lines", found).where("_word").select(*words.columns, "_lines")


def _on_lines(words: DataFrame, lines: Column, columns: list[str]) -> DataFrame:
    """A row of each word for each of its lines, with that line's index."""
    return words.withColumn("_l", F.explode(lines)).withColumn("line_index", F.col("_l._line")).select(*columns)


def line_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Words by the id lists of lines, as (words..., line_index of the line): words that no line lists are dropped, ids without a word skipped."""
    return _on_lines(with_lists(lines, words), F.col("_lines"), words.columns)


def lines_or_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """As ``line_words``, but documents of which no line lists a known word fall back to the words' own line index."""
    listed = with_lists(lines, words).withColumn("_any", F.max(F.size("_lines") > 0).over(Window.partitionBy("doc_id")))
    return _on_lines(listed, F.when(F.col("_any"), F.col("_lines")).otherwise(F.array(F.struct(F.col("line_index").alias("_line")))), words.columns)


def pairs_in(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, l, r): the pairs of rows (keys, l) and (keys, r) with equal keys, as ``join`` finds them.

    A grouping by all keys, which rows that are dealt by the first one need not travel for; a join would deal them anew.
    """
    both = left.select(*keys, "l").unionByName(right.select(*keys, "r"), allowMissingColumns=True).where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    groups = both.groupBy(*keys).agg(F.collect_list("l").alias("_ls"), F.collect_list("r").alias("_rs")).where("size(_ls) > 0 AND size(_rs) > 0")
    return groups.select(*keys, F.explode("_ls").alias("l"), "_rs").select(*keys, "l", F.explode("_rs").alias("r"))


def renumbered(words: DataFrame) -> DataFrame:
    """Word and line indexes made dense from 0, in their order."""
    order, by_line = Window.partitionBy("doc_id").orderBy("line_index", "word_index", "word_id"), Window.partitionBy("doc_id").orderBy("line_index")
    return words.withColumns({"word_index": F.row_number().over(order) - 1, "line_index": F.dense_rank().over(by_line) - 1})


def export_lines(words: DataFrame) -> DataFrame:
    """Non-blank lines for export: box, mean word height (each at least 1), number of words, text with spacing rules."""
    spaced = spaced_words(words)
    b = Box.of()
    out = spaced.groupBy("doc_id", "line_index").agg(
        F.min("x").alias("left"), F.min("y").alias("top"), F.max(b.right).alias("right"), F.max(b.bottom).alias("bottom"), F.avg(F.greatest(F.lit(1.0), F.col("h"))).alias("mean_height"), F.count(F.lit(1)).alias("n_words"), ordered_text("word_index", "_piece", "").alias("text")
    )
    return out.where(~T.is_blank(F.col("text")))


def spaced_words(words: DataFrame) -> DataFrame:
    """``words`` with _piece: the text, after a blank unless the word before it in the line forbids one."""
    before = F.lag("norm_text").over(Window.partitionBy("doc_id", "line_index").orderBy("word_index"))
    joined = before.isNull() | T.joins_previous(before, F.col("norm_text"))
    return words.withColumn("_piece", F.when(joined, F.col("norm_text")).otherwise(F.concat(F.lit(" "), "norm_text")))


def line_breaks(lines: DataFrame) -> DataFrame:
    """Export lines with ``break``: what stands between a line and the one before it (first, paragraph, newline, space or none)."""
    w = Window.partitionBy("doc_id").orderBy("line_index")
    p = {c: F.lag(c).over(w) for c in ("text", "bottom", "mean_height", "n_words")}
    lines = lines.withColumns({f"_{c}": v for c, v in p.items()})
    t, before = F.col("text"), F.col("_text")
    gap, height = F.col("top") - F.col("_bottom"), (F.col("mean_height") + F.col("_mean_height")) / 2
    kind = (
        F.when(before.isNull(), "first")
        .when(gap > PARAGRAPH * height, "paragraph")
        .when(T.is_list_item(t) | T.is_heading(before, F.col("_n_words"), F.col("_mean_height"), F.col("mean_height")) | (gap >= LINE_BREAK * height), "newline")
        .when(before.rlike(r"\p{L}-$") & T.starts_lower(t), "none")
        .when(T.ends_sentence(before) & ~T.starts_lower(t), "newline")
        .otherwise("space")
    )
    return lines.withColumn("break", kind).drop(*(f"_{c}" for c in p))


BREAKS = {"first": "", "paragraph": "\n\n", "newline": "\n", "space": " ", "none": ""}


def reflowed(words: DataFrame) -> DataFrame:
    """(doc_id, text): readable text of each document; documents without words have no row."""
    lines = line_breaks(export_lines(words))
    mark = F.coalesce(*[F.when(F.col("break") == k, F.lit(v)) for k, v in BREAKS.items()])
    return lines.withColumn("_piece", F.concat(mark, "text")).groupBy("doc_id").agg(ordered_text("line_index", "_piece", "").alias("text"))


def _folded(lines: DataFrame, rows: str, shape: str, joins: Callable[[Column, Column], Column], grow: Callable[[Column, Column], list[Column]], both: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(doc_id, line_index, at, grown) of lines whose array ``rows`` is folded in order: an element joins the open one if ``joins``, else opens the next.

    The fold keeps of the open element the fields of ``shape``, which ``grow`` makes of it and the element that joins, and a
    mark for each element, whether it opens one. Spark copies what a fold carries at every step and compiles nothing in it, so
    no texts and nothing that grows with the line but these marks may be in it. Then each run of elements that the marks tell is
    sliced out of the array and grown by ``both``; one that stands alone is taken as it is, and words are grouped only once.
    """
    fields = [f.split(":")[0] for f in shape.removeprefix("struct<").removesuffix(">").split(",")]
    both = both or (lambda a, b: F.struct(*grow(a, b)))

    def step(acc: Column, b: Column) -> Column:
        # Two branches, as what is asked would be computed again for each place in one.
        opens = F.struct(F.struct(*[b[f].alias(f) for f in fields]).cast(shape).alias("open"), F.concat(acc["marks"], F.lit("1")).alias("marks"))
        grows = F.struct(F.struct(*grow(acc["open"], b)).cast(shape).alias("open"), F.concat(acc["marks"], F.lit("0")).alias("marks"))
        return F.when(acc["open"].isNotNull() & F.coalesce(joins(acc["open"], b), F.lit(False)), grows).otherwise(opens)

    marks = F.aggregate(rows, F.struct(F.lit(None).cast(shape).alias("open"), F.lit("").alias("marks")), step, lambda acc: F.concat(acc["marks"], F.lit("1")))
    places = F.zip_with(F.sequence(F.lit(1), F.size(rows) + 1), F.regexp_extract_all(marks, F.lit("."), F.lit(0)), lambda i, mark: F.when(mark == "1", i))
    begun = lines.withColumn("_begun", F.filter(places, lambda i: i.isNotNull()))
    n = F.size("_begun") - 1
    spans = F.zip_with(F.slice("_begun", F.lit(1), n), F.slice("_begun", F.lit(2), n), lambda i, j: F.struct(i.alias("i"), (j - i).alias("n")))
    first = lambda g: F.element_at(rows, g["i"])
    grown = F.transform(spans, lambda g: F.when(g["n"] == 1, first(g)).otherwise(F.aggregate(F.slice(rows, g["i"] + 1, g["n"] - 1), first(g), both)))
    return begun.select("doc_id", "line_index", F.posexplode(grown).alias("at", "grown"))


def merged_fragments(words: DataFrame, reach: float = 0.12) -> DataFrame:
    """Words of a line whose neighbours nearly touch, merged into one: an ordered fold, as each test is on what has grown so far.

    Merges when the gap is at most ``reach`` of the mean height, both are letters and digits alone of one script, and
    neither is a word of one letter. The first word's id stays, boxes unite, confidences are averaged over those given.
    What is asked of texts is asked of each word before the fold: what has grown is plain, and of the script of its parts.
    """
    t = F.col("norm_text")
    plain = F.coalesce(t.rlike(r"^[\p{L}\p{Nd}]+$") & (F.length(t) > 1), F.lit(False))
    script = F.when(~plain, None).when(t.rlike(r"\p{IsCyrillic}"), 1).when(t.rlike(r"\p{IsLatin}"), 2)
    word = F.struct("word_index", "word_id", "norm_text", "x", "y", "w", "h", "confidence", F.lit(1).alias("parts"), plain.alias("plain"), script.alias("script"))
    row = "struct<word_index:bigint,word_id:string,norm_text:string,x:double,y:double,w:double,h:double,confidence:double,parts:int,plain:boolean,script:int>"
    # The word is made before the grouping, where it is compiled.
    lines = words.select("doc_id", "line_index", word.cast(row).alias("_word")).groupBy("doc_id", "line_index").agg(F.sort_array(F.collect_list("_word")).alias("_words"))

    def fits(a: Column, b: Column) -> Column:
        gap = b["x"] - (a["x"] + a["w"])
        close = (gap <= reach * (a["h"] + b["h"]) / 2) & (gap >= -reach * (a["h"] + b["h"]) / 2)
        return a["plain"] & b["plain"] & close & F.coalesce(a["script"] == b["script"], F.lit(True))

    def grow(a: Column, b: Column) -> list[Column]:
        box = Box(a["x"], a["y"], a["w"], a["h"]).union(Box(b["x"], b["y"], b["w"], b["h"]))
        return [*box.columns(), a["plain"].alias("plain"), F.coalesce(a["script"], b["script"]).alias("script")]

    def both(a: Column, b: Column) -> Column:
        x, y, w, h, plain, script = grow(a, b)
        mean = F.coalesce((a["confidence"] + b["confidence"]) / 2, a["confidence"], b["confidence"]).alias("confidence")
        texts = F.concat(a["norm_text"], b["norm_text"]).alias("norm_text")
        return F.struct(a["word_index"].alias("word_index"), a["word_id"].alias("word_id"), texts, x, y, w, h, mean, (a["parts"] + b["parts"]).alias("parts"), plain, script).cast(row)

    shape = "struct<x:double,y:double,w:double,h:double,plain:boolean,script:int>"
    out = _folded(lines, "_words", shape, fits, grow, both).select("doc_id", "line_index", "grown.*").drop("plain", "script")
    return out.withColumn("text", F.col("norm_text"))


def merged_rects(words: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Boxes of a line joined from left to right while the gap is at most ``tolerance`` of the height grown so far: an ordered fold.

    (doc_id, line_index, at, x, y, w, h): few rectangles that cover a selection.
    """
    box = "struct<x:double,y:double,w:double,h:double>"
    boxes = words.select("doc_id", "line_index", F.struct("x", "y", "w", "h").alias("_box")).groupBy("doc_id", "line_index").agg(F.sort_array(F.collect_list("_box")).alias("_boxes"))
    joins = lambda a, b: b["x"] - (a["x"] + a["w"]) <= tolerance * a["h"]
    grow = lambda a, b: Box(a["x"], a["y"], a["w"], a["h"]).union(Box(b["x"], b["y"], b["w"], b["h"])).columns()
    return _folded(boxes, "_boxes", box, joins, grow).select("doc_id", "line_index", "at", "grown.*")


def row_runs(rows: DataFrame, key: str = "doc_id", y: str = "y", ink: str = "ink", least: int = 1, gap: int = 2, shortest: int = 1) -> DataFrame:
    """Runs of rows with at least ``least`` ink, bridging ``gap`` empty rows: (key, top, bottom), bottom inclusive; gaps and islands by lag."""
    w = Window.partitionBy(key).orderBy(y)
    inked = rows.where(F.col(ink) >= least).withColumn("_new", F.coalesce((F.col(y) - F.lag(y).over(w) > gap + 1).cast("int"), F.lit(0)))
    runs = inked.withColumn("_run", F.sum("_new").over(w)).groupBy(key, "_run").agg(F.min(y).alias("top"), F.max(y).alias("bottom"))
    return runs.where(F.col("bottom") - F.col("top") + 1 >= shortest).drop("_run")


def merged_regions(regions: DataFrame, key: str = "doc_id", gap: float = 4.0) -> DataFrame:
    """Regions (top, bottom) merged while the next begins within ``gap`` of the lowest bottom so far: islands against a running maximum."""
    w = Window.partitionBy(key).orderBy("top", "bottom")
    reached = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = regions.withColumn("_new", F.coalesce((F.col("top") > reached + gap).cast("int"), F.lit(0)))
    return marked.withColumn("_region", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "_region").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")).drop("_region")


def bands(images: DataFrame, height: int = 160, overlap: int = 24) -> DataFrame:
    """Overlapping horizontal bands of images (doc_id, image_h): (doc_id, band, top, bottom); the last one ends with the image."""
    step = height - overlap
    tops = F.sequence(F.lit(0), F.greatest(F.col("image_h") - overlap - 1, F.lit(0)), F.lit(step))
    out = images.where("image_h > 0").select("doc_id", "image_h", F.posexplode(tops).alias("band", "top"))
    return out.select("doc_id", "band", "top", F.least(F.col("top") + height, F.col("image_h")).alias("bottom"))
