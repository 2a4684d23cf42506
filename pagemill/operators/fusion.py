"""Fusing several recognisers' words of the same documents, and merging candidates by coverage.

Grouping, line building and coverage depend on the order in which words come (a word joins one group, boxes grow), so
they are ordered folds: a window brings a document's words together from top to bottom, and Arrow batches of many documents
fold at once, each cut across its height where nothing reaches over. Numpy finds the pairs of words that show the same by grid
cells; what they leave no choice in is decided for a whole batch, and the fold goes over the other pairs alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import script as S
from pagemill.functions import text as T
from pagemill.functions.geometry import Box
from pagemill.operators.layout import pairs_in
from pagemill.operators.quality import WORD_CONFIDENCE

#: Overlap that makes two words one; less suffices for the same token; or centres this near, in heights, for the same token.
OVERLAP, OVERLAP_SAME, NEAR = 0.35, 0.15, 0.6
#: Shared height over the smaller height that puts a word on a line.
LINE_OVERLAP = 0.5
#: What a group's protected or Cyrillic readings are worth to each other.
GROUP_PROTECTED, GROUP_CYRILLIC = 20, 10
#: The overlap of boxes of which only the centres are near.
TRIFLE = 1e-6
CELL = 128.0
NOT_WORD = re.compile(r"[^\w]|_")


def united(branches: list[tuple[str, DataFrame]]) -> DataFrame:
    """Words of all branches, with branch_index and language."""
    return _tagged(branches).where(~T.is_blank(F.col("norm_text")))


def _tagged(branches: list[tuple[str, DataFrame]]) -> DataFrame:
    """``united`` with blank words."""
    out = None
    for i, (language, words) in enumerate(branches):
        tagged = words.withColumns({"branch_index": F.lit(i), "language": F.lit(language)})
        out = tagged if out is None else out.unionByName(tagged)
    return out


def overlapping(left: DataFrame, right: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of words of the same document that are visibly the same: (doc_id, left_id, right_id, overlap).

    Boxes overlap by OVERLAP, or by OVERLAP_SAME with the same token, or their centres are near with the same token; then
    overlap is a trifle at least. A spatial join on (document, grid cell): boxes, widened by NEAR of their height as
    centres may be that far apart, lie in every cell they touch, and a pair is kept in the cell that holds the upper left
    corner of what they share, so nothing is repeated and no cell meets another. Tokens are folded before they are repeated.
    """

    def cells(words: DataFrame, side: str) -> DataFrame:
        wide = Box.of().inflated(NEAR * F.col("h"))
        span = lambda a, z: F.sequence(F.floor(a / cell).cast("int"), F.floor(F.greatest(a, z) / cell).cast("int"))
        kept = words.select("doc_id", F.col("word_id").alias(f"{side}_id"), T.folded(F.col("norm_text")).alias(f"{side}_fold"), *Box.of().columns(side), span(wide.x, wide.right).alias("_xs"), span(wide.y, wide.bottom).alias("_ys"))
        return kept.withColumn("_cx", F.explode("_xs")).withColumn("_cy", F.explode("_ys")).drop("_xs", "_ys")

    packed = lambda words, side: cells(words, side).select("doc_id", "_cx", "_cy", F.struct(f"{side}_id", f"{side}_fold", *(f"{side}{c}" for c in "xywh")).alias(side))
    met = pairs_in(packed(left, "l"), packed(right, "r"), "doc_id", "_cx", "_cy").select("doc_id", "_cx", "_cy", "l.*", "r.*")
    a, b = Box.of("l"), Box.of("r")
    wide_a, wide_b = a.inflated(NEAR * a.h), b.inflated(NEAR * b.h)
    here = (F.floor(F.greatest(wide_a.x, wide_b.x) / cell) == F.col("_cx")) & (F.floor(F.greatest(wide_a.y, wide_b.y) / cell) == F.col("_cy"))
    near = F.greatest(F.abs(a.middle_x - b.middle_x), F.abs(a.middle_y - b.middle_y)) <= NEAR * F.greatest(a.h, b.h)
    met = met.withColumn("_overlap", a.overlap(b)).where((F.col("_overlap") >= OVERLAP_SAME) | near)
    same = T.same_folded(F.col("l_fold"), F.col("r_fold"))
    kept = met.where(here & ((F.col("_overlap") >= OVERLAP) | same))
    return kept.select("doc_id", F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), F.greatest("_overlap", F.lit(TRIFLE)).alias("overlap"))


def word_preference(words: DataFrame) -> Column:
    """How good a reading is in a fusion, by itself: confidence, length, plainness; less for two scripts in one token or a language that does not fit."""
    t = F.col("norm_text")
    confidence = F.coalesce("confidence", F.lit(WORD_CONFIDENCE))
    fits = F.when((F.col("language") == "Russian") & t.rlike(S.CYRILLIC), 6).when((F.col("language") == "English") & t.rlike(S.LATIN), 6).otherwise(0) if "language" in words.columns else F.lit(0)
    return confidence + F.least(F.length(t), F.lit(12)) * 1.5 + fits + F.when(S.is_protected(t, codes=False), 8).otherwise(0) - F.when(S.is_corrupted_reading(t), 25).otherwise(0) - F.when(T.is_textual(t), 0).otherwise(15)


def group_preference(any_cyrillic, any_protected, cyrillic, protected):
    """What the readings of a group add to each other's preference; for columns, arrays or booleans alike.

    Where one reading is an address, path or code, such readings gain and Cyrillic ones lose; else, where one is
    Cyrillic, Cyrillic ones gain, as Latin readings of Cyrillic words are look-alikes.
    """
    return GROUP_PROTECTED * any_protected * (protected * 1 - cyrillic * 1) + GROUP_CYRILLIC * (any_cyrillic * 1 - any_cyrillic * any_protected) * cyrillic


def coverage_preference(t: Column, confidence: Column) -> Column:
    """How good a reading is where candidates are merged by coverage: confidence, letters and digits that tell, and no two scripts in one token."""
    # Most tokens are letters and digits alone, so that their length tells how many.
    plain = t.rlike(rf"^[{T.LETTER}{T.DIGIT}]+$")
    telling = F.least(F.when(plain, F.length(t)).otherwise(T.count_of(t, f"[{T.LETTER}{T.DIGIT}]")), F.lit(20))
    return 0.6 * F.coalesce(confidence, F.lit(WORD_CONFIDENCE)) + 2 * telling - F.when(plain, 0).otherwise(T.symbols(t)) - F.when(S.is_corrupted_reading(t, stray=True), 18).otherwise(0)


def _fold(t: str) -> str:
    return NOT_WORD.sub("", t).upper()


def _same_token(a: str, b: str) -> bool:
    return bool(a) and (a == b or (min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 2 and (a in b or b in a)))


@dataclass(frozen=True)
class SameWord:
    """When two boxes show the same word: they overlap by ``overlap``, or by ``same`` with the same token, or their centres
    are within ``near`` heights, with the same token or whatever the text."""

    overlap: float = OVERLAP
    same: float = OVERLAP_SAME
    near: float = NEAR
    whatever: bool = False

    def of(self, a, b, fold_a: str, fold_b: str) -> float:
        """Overlap if two boxes show the same word, at least a trifle when only their centres are near; 0 if not."""
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        o = max(w, 0.0) * max(h, 0.0) / max(min(a[2] * a[3], b[2] * b[3]), 1.0)
        if o >= self.overlap:
            return o
        same = _same_token(fold_a, fold_b)
        if same and o >= self.same:
            return o
        dx, dy = a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2
        return max(o, TRIFLE) if (same or self.whatever) and max(abs(dx), abs(dy)) <= self.near * max(a[3], b[3]) else 0.0

    def pairs(self, boxes: np.ndarray, folds: list[str] | Callable[[np.ndarray], list[str]], part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs (later, earlier, overlap) of rows that show the same word, ordered by the later one; boxes that aren't finite show none.

        Boxes widened by ``near`` of their height lie in every cell that they touch, and a pair is found in the cell that
        holds the upper left corner of what both share. ``folds``: folded texts, or what gives those of rows; only those that
        decide are asked for. ``part``: rows of different parts (0, 1, ...) don't meet; each has cells of its own size.
        """
        none = np.zeros(0, np.int64)
        rows = np.flatnonzero(np.isfinite(boxes).all(1))
        if len(rows) < 2:
            return none, none, np.zeros(0)
        given = folds if callable(folds) else lambda at: [folds[i] for i in at.tolist()]
        own_part = np.zeros(len(rows), np.int64) if part is None else part[rows]
        x, y, w, h = np.ascontiguousarray(boxes[rows].T)
        low, high = np.stack([x - self.near * h, y - self.near * h]), np.stack([x + w + self.near * h, y + h + self.near * h])
        side = np.stack([_cell_sides(extent, own_part)[own_part] for extent in high - low])
        first, last = np.floor(low / side).astype(np.int64), np.floor(np.maximum(low, high) / side).astype(np.int64)
        across, down = last - first + 1
        n_cells = across * down
        owner = np.repeat(np.arange(len(rows)), n_cells)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells)
        cx, cy = first[0][owner] + at % across[owner], first[1][owner] + at // across[owner]
        in_part = own_part[owner]
        order = _by_keys(in_part, cy, cx)
        owner, cx, cy, in_part = owner[order], cx[order], cy[order], in_part[order]
        begins = np.flatnonzero(np.r_[True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]) | (in_part[1:] != in_part[:-1])])
        sizes = np.diff(np.r_[begins, len(owner)])
        # Each entry of a cell with those before it there.
        before = np.arange(len(owner)) - np.repeat(begins, sizes)
        found = []
        for portion in _portions(before, 4_000_000):
            n = before[portion]
            b = np.repeat(portion, n)
            a = b - 1 - (np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n))
            i, j = owner[a], owner[b]
            shared_w = np.minimum(x[i] + w[i], x[j] + w[j]) - np.maximum(x[i], x[j])
            shared_h = np.minimum(y[i] + h[i], y[j] + h[j]) - np.maximum(y[i], y[j])
            o = np.maximum(shared_w, 0) * np.maximum(shared_h, 0) / np.maximum(np.minimum(w[i] * h[i], w[j] * h[j]), 1.0)
            close = np.maximum(np.abs(x[i] + w[i] / 2 - x[j] - w[j] / 2), np.abs(y[i] + h[i] / 2 - y[j] - h[j] / 2)) <= self.near * np.maximum(h[i], h[j])
            maybe = np.flatnonzero((o >= self.overlap) | (o >= self.same) | close)
            i, j, o, close, b = i[maybe], j[maybe], o[maybe], close[maybe], b[maybe]
            corner = np.floor(np.maximum(low[:, i], low[:, j]) / side[:, i])
            own = (corner[0] == cx[b]) & (corner[1] == cy[b])
            i, j, o, close = rows[i[own]], rows[j[own]], o[own], close[own]
            yes = (o >= self.overlap) | (close & self.whatever)
            ask = np.flatnonzero(~yes)
            if len(ask):
                yes[ask] = [_same_token(p, q) for p, q in zip(given(i[ask]), given(j[ask]), strict=True)]
            found.append((np.maximum(i, j)[yes], np.minimum(i, j)[yes], np.where(close, np.maximum(o, TRIFLE), o)[yes]))
        later, earlier, overlap = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, np.zeros(0))
        order = np.lexsort((earlier, later))
        return later[order], earlier[order], overlap[order]


def _cell_sides(extent: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Of each part the side of its cells: about a box's extent, so that a box lies in few, the largest one in some 4096."""
    n = np.bincount(part)
    most = np.zeros(len(n))
    np.maximum.at(most, part, extent)
    return np.maximum(np.maximum(np.bincount(part, extent) / np.maximum(n, 1), most / 4096), 1.0)


def _by_keys(*keys: np.ndarray) -> np.ndarray:
    """``lexsort`` of whole numbers, the first key first: of one number made of all, where they fit."""
    lows, spans = [int(k.min()) for k in keys], [int(k.max()) - int(k.min()) + 1 for k in keys]
    if math.prod(spans) >= 1 << 62:
        return np.lexsort(keys[::-1])
    one = np.zeros(len(keys[0]), np.int64)
    for k, low, span in zip(keys, lows, spans, strict=True):
        one = one * span + (k - low)
    return np.argsort(one, kind="stable")


def _ordered(ids: Callable[[np.ndarray], list[str]], *keys: np.ndarray) -> np.ndarray:
    """The order of rows by keys, the first one first, ties by the ids; only ids of rows that tie are asked for."""
    order = np.lexsort(keys[::-1])
    tied = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        a, b = k[order[:-1]], k[order[1:]]
        tied &= (a == b) | ((a != a) & (b != b))
    if tied.any():
        at = np.flatnonzero(np.r_[tied, False] | np.r_[False, tied])
        run = np.cumsum(~np.r_[False, tied])[at].tolist()
        names = ids(order[at])
        order[at] = order[at[sorted(range(len(at)), key=lambda i: (run[i], names[i]))]]
    return order


def _strings(column: pa.Array | pa.ChunkedArray | pd.Series) -> Callable[[np.ndarray], list[str]]:
    """What gives the strings of rows, made only for them."""
    column = pa.array(column, pa.string()) if isinstance(column, pd.Series) else column
    return lambda rows: column.take(pa.array(rows)).to_pylist()


def _folds(column: pa.Array | pa.ChunkedArray | pd.Series, order: np.ndarray | None = None) -> Callable[[np.ndarray], list[str]]:
    """What gives the folded texts of rows, which ``order`` tells the places of."""
    texts = _strings(column)
    return lambda rows: [_fold(t) for t in texts(rows if order is None else order[rows])]


def _portions(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Consecutive indexes whose sizes add up to about ``most``."""
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(most, int(sizes.sum()), most))
    yield from np.split(np.arange(len(sizes)), np.unique(cuts))


FUSION, COVERAGE = SameWord(), SameWord(overlap=0.35, same=0.2, near=0.5, whatever=True)


def same_visible_word(a, b, fold_a: str, fold_b: str) -> float:
    return FUSION.of(a, b, fold_a, fold_b)


def _single(later: np.ndarray, earlier: np.ndarray, n: int) -> np.ndarray:
    """Which pairs are of two rows that are in no other pair: nothing else has a say in what becomes of them."""
    times = np.bincount(later, minlength=n) + np.bincount(earlier, minlength=n)
    return (times[later] == 1) & (times[earlier] == 1)


def grouped_words(words: pd.DataFrame | Words, part: np.ndarray | None = None) -> np.ndarray:
    """Of each row its group: rows in the order (y, x, branch, index) join the group with the greatest overlap, of several the oldest, else open one.

    Rows of different parts are in different groups.
    """
    numbers = [np.asarray(words[c]) for c in ("y", "x", "branch_index", "word_index")]
    order = _ordered(_strings(words["word_id"]), *([] if part is None else [part]), *numbers)
    boxes = np.stack([np.asarray(words[c], float) for c in "xywh"], axis=1)[order]
    later, earlier, overlap = FUSION.pairs(boxes, _folds(words["norm_text"], order), None if part is None else part[order])
    group_of = np.arange(len(order))  # a group is known by the row that opened it, so older ones are smaller
    single = _single(later, earlier, len(order))
    group_of[later[single]] = earlier[single]
    found: dict[int, int] = {}
    k, best, at = -1, 0.0, -1
    for k_next, m, o in zip(later[~single].tolist(), earlier[~single].tolist(), overlap[~single].tolist(), strict=True):
        if k_next != k:
            k, best = k_next, 0.0
        g = found.get(m, m)
        if o > best or (o == best and g < at):
            best, at = o, g
            found[k] = g
    group_of[list(found)] = list(found.values())
    out = np.empty(len(order), np.int64)
    out[order] = group_of
    return out


def built_lines(boxes: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
    """Of each box its line: boxes from top to bottom join the first line with which they share enough height; lines grow and are numbered by their tops.

    Boxes are parted where none reaches over. Where all of them share enough height whatever their line has grown to they are
    one line; the others are swept. As boxes come by their tops, so do lines. ``part``: (0, 1, ...) lines of each part.
    """
    if not len(boxes):
        return np.zeros(0, np.int64)
    part = np.zeros(len(boxes), np.int64) if part is None else part
    order = np.lexsort((boxes[:, 0], boxes[:, 1], part))
    x, y, w, h = np.ascontiguousarray(boxes[order].T)
    part, bottom = part[order], y + h
    begins = np.r_[True, part[1:] != part[:-1]]
    finite = np.isfinite(boxes[order]).all(1)
    odd = np.bincount(part, ~finite) > 0  # such parts are swept whole
    reached = _running_max(np.where(finite, bottom, 0.0), part)
    islands = np.flatnonzero(begins | (np.r_[False, y[1:] >= reached[:-1]] & ~odd[part]))
    ends = np.r_[islands[1:], len(y)]
    # Of floats, differences are as monotonous as of numbers, so this bounds what each box would be asked.
    simple = np.minimum.reduceat(bottom, islands) - y[ends - 1] >= LINE_OVERLAP * np.maximum(np.maximum.reduceat(h, islands), 1e-9)
    simple &= ~odd[part[islands]]
    member, n_lines = np.zeros(len(y), np.int64), np.ones(len(islands), np.int64)
    for i in np.flatnonzero(~simple).tolist():
        rows = slice(islands[i], ends[i])
        member[rows], n_lines[i] = _swept(y[rows].tolist(), h[rows].tolist())
    # Lines before an island in its part.
    before = np.cumsum(n_lines) - n_lines
    firsts = np.flatnonzero(begins[islands])
    before -= np.repeat(before[firsts], np.diff(np.r_[firsts, len(islands)]))
    out = np.empty(len(y), np.int64)
    out[order] = member + np.repeat(before, ends - islands)
    return out


def _running_max(values: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The greatest value up to each row within its part; parts ascend."""
    levels, level = np.unique(values, return_inverse=True)
    return levels[np.maximum.accumulate(part * len(levels) + level) - part * len(levels)]


def _swept(ys: list[float], hs: list[float]) -> tuple[list[int], int]:
    """Lines of boxes that come by their tops, and how many: a line whose bottom lies above a box is done, so only open ones are looked at."""
    tops: list[float] = []
    bottoms: list[float] = []
    member: list[int] = []
    open_lines: list[int] = []
    for y, h in zip(ys, hs, strict=True):
        hit, done = -1, False
        for i in open_lines:
            shared = min(bottoms[i], y + h) - max(tops[i], y)
            if shared >= LINE_OVERLAP * max(min(bottoms[i] - tops[i], h), 1e-9):
                hit = i
                break
            done = done or bottoms[i] <= y
        if done:
            open_lines = [i for i in open_lines if bottoms[i] > y]
        if hit < 0:
            hit = len(tops)
            tops.append(y)
            bottoms.append(y + h)
            open_lines.append(hit)
        elif y + h > bottoms[hit]:
            bottoms[hit] = y + h
        member.append(hit)
    return member, len(tops)


#: Words of a piece of a document, at least; a piece ends where nothing reaches over.
PIECE = 4000


def in_pieces(words: DataFrame, least: int = PIECE) -> DataFrame:
    """``words`` with _piece: a document cut across its height where no word can meet or share a line with one beyond.

    Words reach (NEAR - 0.5) of their height over their box, as far as centres can lie apart when boxes don't touch. In the
    order of their upper reach, a cut is safe where no word before reaches down to the next. Cuts are taken once ``least``
    words have come, so that pieces are of about that size, or as large as what hangs together.
    """
    reach = max(NEAR - 0.5, 0.0) * F.greatest("h", F.lit(0.0))
    order = Window.partitionBy("doc_id").orderBy("_from", "y", "word_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumns({"_from": F.col("y") - reach, "_to": F.col("y") + F.greatest("h", F.lit(0.0)) + reach})
    words = words.withColumns({"_before": F.max("_to").over(so_far), "_n": F.row_number().over(order)})
    islands = words.withColumn("_start", F.when(F.col("_before").isNull() | (F.col("_from") > F.col("_before")), F.col("_n")))
    begun = F.max("_start").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return islands.withColumn("_piece", F.floor((begun - 1) / F.lit(least))).drop("_from", "_to", "_before", "_n", "_start")


FUSED = "doc_id {id}, word_id string, word_index long, line_index int, text string, norm_text string, x double, y double, w double, h double, confidence double"
#: Rows of many documents that fold at once; more, where a document hangs together.
ROWS = 1 << 16


class Words:
    """Words in Arrow columns: numbers as arrays, made once; strings stay in Arrow, and rows are taken of them."""

    def __init__(self, table: pa.Table):
        self.table, self.known = table, {}

    def __getitem__(self, name: str):
        column = self.table.column(name)
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            return column
        if name not in self.known:
            self.known[name] = column.to_numpy()
        return self.known[name]

    def boxes(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.asarray(self[c], float)[rows] for c in "xywh"], axis=1)


def _relined(words: Words, rows: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in their new order, part and line of each): ``rows`` in lines built anew within each part."""
    line = built_lines(words.boxes(rows), part)
    ids = _strings(words["word_id"])
    order = _ordered(lambda at: ids(rows[at]), part, line, words["x"][rows], words["y"][rows])
    return rows[order], part[order], line[order]


def _chosen(words: Words, part: np.ndarray) -> np.ndarray:
    """The rows with the best reading of each group of words, in the order of their groups."""
    group = grouped_words(words, part)
    cyrillic, protected, score = words["_cyrillic"], words["_protected"], words["_score"]
    any_of = lambda flag: np.bincount(group, flag)[group].astype(bool)
    score = score + group_preference(any_of(cyrillic) * 1, any_of(protected) * 1, cyrillic, protected)
    order = _ordered(_strings(words["word_id"]), group, -score, words["branch_index"], words["word_index"])
    return order[np.r_[True, np.diff(group[order]) != 0]]


def _judged(branches: list[tuple[str, DataFrame]]) -> DataFrame:
    """The branches' words, blank ones too, with what the choice between readings looks at."""
    words, t = _tagged(branches), F.col("norm_text")
    return words.withColumns({"_score": word_preference(words).cast("double"), "_cyrillic": t.rlike(S.CYRILLIC).cast("int"), "_protected": S.is_protected(t, codes=False).cast("int")})


def _by_piece(words: DataFrame, fold: Callable[[Words, np.ndarray], np.ndarray], least: int, *asked: str) -> DataFrame:
    """Words that are not blank, document by document, through ``fold``, which chooses rows of many pieces of documents at once; words and lines are numbered through each document, as its pieces come from top to bottom.

    Pieces are those of ``in_pieces``. A window deals and sorts the words and numbers those of a document, so what comes to a
    task is whole documents from top to bottom; one whose rows came otherwise would be an error, not another result. Of a
    document that is longer than a batch the rows after its last safe cut wait for the next one. ``asked``: the columns that
    the fold looks at beside those of words.
    """
    id_type, rows_at_once = words.schema["doc_id"].dataType.simpleString(), ROWS
    reach = max(NEAR - 0.5, 0.0) * F.greatest("h", F.lit(0.0))
    # Blank words go after the window: a filter before it would make each text twice, and what makes it may be much.
    placed = words.withColumns({"_from": F.col("y") - reach, "_full": ~T.is_blank(F.col("norm_text"))})
    so_far = Window.partitionBy("doc_id").orderBy("_from").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_n", F.count(F.when(F.col("_full"), 1)).over(so_far)).where("_full")
    # Texts travel to the fold if they differ from the tokens.
    differs = ~F.col("text").eqNullSafe(F.col("norm_text"))
    placed = placed.select("doc_id", "word_id", "word_index", F.when(differs, F.col("text")).alias("text"), "norm_text", "x", "y", "w", "h", "confidence", "_n", differs.alias("_differs"), *asked)
    names = [n.split()[0] for n in FUSED.split(", ")]
    types = [None, pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 5]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going_on, n_words, n_lines = False, 0, 0  # of the document that the last batch broke off in
        for table, doc, piece, broken in _whole_pieces(batches, least, rows_at_once):
            part = np.cumsum(np.r_[False, (np.diff(doc) != 0) | (np.diff(piece) != 0)])
            found = Words(table)
            kept = fold(found, part)
            rows, part, line = _relined(found, kept, part[kept])
            begins = np.flatnonzero(np.r_[True, np.diff(doc[rows]) != 0])
            sizes = np.diff(np.r_[begins, len(rows)])
            through = lambda at: at - np.repeat(at[begins], sizes)  # noqa: B023, E731
            word_at = through(np.arange(len(rows)))
            line_at = through(np.cumsum(np.r_[False, (np.diff(line) != 0) | (np.diff(part) != 0)]))
            if going_on:
                word_at[: sizes[0]] += n_words
                line_at[: sizes[0]] += n_lines
            going_on, n_words, n_lines = broken, int(word_at[-1]) + 1, int(line_at[-1]) + 1
            made = {"word_index": pa.array(word_at, pa.int64()), "line_index": pa.array(line_at.astype(np.int32))}
            taken = table.select([*(n for n in names if n not in made), "_differs"]).take(pa.array(rows))
            made["text"] = pc.if_else(taken.column("_differs"), taken.column("text"), taken.column("norm_text"))
            out = [made[n] if n in made else taken.column(n) for n in names]
            yield from pa.Table.from_arrays([c if t is None else c.cast(t) for c, t in zip(out, types, strict=True)], names).to_batches()

    return placed.mapInArrow(documents, FUSED.format(id=id_type))


def _whole_pieces(batches: Iterator[pa.RecordBatch], least: int, rows: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, bool]]:
    """Batches of sorted documents as (table, document, piece, whether the last document goes on): some ``rows`` at once, cut where it is safe."""
    waiting, n_waiting, enough, more = [], 0, rows, True
    while more:
        batch = next(batches, None)
        more = batch is not None
        if more:
            waiting.append(batch)
            n_waiting += batch.num_rows
        if not n_waiting or (more and n_waiting < enough):
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        doc, starts, piece = _cuts(table, least)
        cut = int(np.flatnonzero(starts)[-1]) if more else n_waiting  # the last document may go on
        if cut:
            yield table.slice(0, cut), doc[:cut], piece[:cut], cut < n_waiting and doc[cut - 1] == doc[cut]
        waiting, n_waiting = table.slice(cut).to_batches(), n_waiting - cut
        enough = max(rows, 2 * n_waiting)


def _cuts(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its document (0, 1, ...), whether a cut before it is safe, and its piece, see ``in_pieces``; the table begins at a document or at a safe cut."""
    ids = table.column("doc_id").combine_chunks().dictionary_encode("encode").indices.to_numpy()
    n = table.column("_n").to_numpy()
    begins = np.r_[True, np.diff(ids) != 0]
    doc = np.cumsum(begins) - 1
    y, tall = table.column("y").fill_null(-np.inf).to_numpy(), np.maximum(table.column("h").fill_null(0.0).to_numpy(), 0.0)
    reach = max(NEAR - 0.5, 0.0) * tall
    # What is not a number comes last, as the window sorts it.
    top, end = (np.where(np.isnan(v), np.inf, v) for v in (y - reach, y + tall + reach))
    if len(np.unique(ids)) != doc[-1] + 1 or (np.diff(n)[~begins[1:]] != 1).any() or (n[begins][1:] != 1).any():
        raise RuntimeError("pieces of a document came out of order")
    before = np.r_[-np.inf, _running_max(end, doc)[:-1]]
    starts = begins | (before == -np.inf) | (top > before)
    begun = np.maximum.accumulate(np.where(starts, np.arange(len(n)), 0))
    return doc, starts, (n[begun] - 1) // least


def fused(branches: list[tuple[str, DataFrame]], least: int = PIECE) -> DataFrame:
    """One word of each group of readings of the same visible word, in lines built anew.

    The best reading by ``word_preference`` and ``group_preference`` is taken, ties by branch and order. Documents are cut
    where nothing reaches over, so that of a long one a piece is in memory; the cuts don't change the outcome.
    """
    return _by_piece(_judged(branches), _chosen, least, "branch_index", "_score", "_cyrillic", "_protected")


#: Words of lines that are fused at once, about.
LINES = 1 << 14


def routed(branches: list[tuple[str, DataFrame]], routes: DataFrame) -> DataFrame:
    """Lines read by several recognisers, each taken as its route (doc_id, line_index, route) says: one branch's reading, or all fused.

    Only lines with the route ``Fused`` go through the fold, each by itself; the others keep the words of the branch whose
    language their route names and bypass it. Lines are then numbered by top and left of their boxes, words from left to right.
    A line without a route, or with one that no branch has, is left out.
    """
    # A window over words and routes by line gives each word its route, so that words dealt by document stay where they are.
    known = routes.select("doc_id", "line_index", F.col("route").alias("_route")).where("doc_id IS NOT NULL AND line_index IS NOT NULL")
    words = _judged(branches).withColumn("_word", F.lit(True)).unionByName(known, allowMissingColumns=True)
    words = words.withColumn("_full", ~T.is_blank(F.col("norm_text")) & F.col("_word"))
    words = words.withColumn("route", F.max("_route").over(Window.partitionBy("doc_id", "line_index"))).where("_full AND (route = 'Fused' OR route = language)")
    columns = ["doc_id", "word_id", "text", "norm_text", "x", "y", "w", "h", "confidence"]
    taken = words.where("route = language").select(*columns, F.col("line_index").alias("_source"), F.lit(0).alias("_part"))

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        found, part = Words(pa.Table.from_pandas(pdf, preserve_index=False)), pdf["_line"].rank(method="dense").to_numpy(np.int64) - 1
        kept = _chosen(found, part)
        rows, part, line = _relined(found, kept, part[kept])
        return pdf[[*columns, "_source"]].take(rows).assign(_part=line)

    # Many lines fold together, as they come: a line is known by its first row, and some LINES rows of a partition are a group.
    # So lines without words to choose from cost no group of their own, and only words that are fused travel for it.
    schema = f"doc_id {words.schema['doc_id'].dataType.simpleString()}, word_id string, text string, norm_text string, x double, y double, w double, h double, confidence double, _source int, _part int"
    fold = words.where("route = 'Fused'").withColumn("_id", F.monotonically_increasing_id()).withColumn("_line", F.min("_id").over(Window.partitionBy("doc_id", "line_index")))
    fold = fold.select(*columns, F.col("line_index").cast("int").alias("_source"), "_line", "word_index", "branch_index", "_score", "_cyrillic", "_protected", F.floor(F.col("_line") / LINES).alias("_lines"))
    fold = fold.groupBy("_lines").applyInPandas(lines, schema)
    both = taken.select(*columns, F.col("_source").cast("int").alias("_source"), "_part").unionByName(fold)
    line = Window.partitionBy("doc_id", "_source", "_part")
    both = both.withColumns({"_top": F.min("y").over(line), "_left": F.min("x").over(line)})
    place = ["_top", "_left", "_source", "_part"]
    numbered = both.withColumns({"line_index": F.dense_rank().over(Window.partitionBy("doc_id").orderBy(*place)) - 1, "word_index": (F.row_number().over(Window.partitionBy("doc_id").orderBy(*place, "x", "y", "word_id")) - 1).cast("long")})
    return numbered.select("doc_id", "word_id", "word_index", "line_index", *columns[2:])


def coverage_places(words: pd.DataFrame | Words, part: np.ndarray | None = None, order: np.ndarray | None = None) -> np.ndarray:
    """Rows, in the order in which they come, that are kept: a later one takes the oldest kept place that shows the same if its _score is better, and no place if it isn't; one that shows nothing kept is added.

    ``order`` tells in which order rows come, ``part`` (of rows in this order) which can meet.
    """
    order = np.arange(len(words["_score"])) if order is None else order
    boxes = np.stack([np.asarray(words[c], float) for c in "xywh"], axis=1)[order]
    later, earlier, _ = COVERAGE.pairs(boxes, _folds(words["norm_text"], order), part)
    score = np.asarray(words["_score"])[order]
    holds = np.arange(len(order))  # who holds the place that a row has opened; none where it has opened none
    single = _single(later, earlier, len(order))
    k, m = later[single], earlier[single]
    holds[k] = -1
    better = score[k] > score[m]
    holds[m[better]] = k[better]
    later, earlier = later[~single], earlier[~single]
    rows, begins = np.unique(later, return_index=True)
    ends, earlier = np.searchsorted(later, rows, side="right").tolist(), earlier.tolist()
    # Of the rows that are kept now who opened their places; those that show nothing before them open one.
    place_of = {m: m for m in set(earlier).difference(rows.tolist())}
    for k, a, b in zip(rows.tolist(), begins.tolist(), ends, strict=True):
        hit = min((place_of[m] for m in earlier[a:b] if m in place_of), default=-1)
        if hit < 0:
            place_of[k] = k
            continue
        holds[k] = -1
        if score[k] > score[holds[hit]]:
            del place_of[int(holds[hit])]
            holds[hit], place_of[k] = k, hit
    return order[holds[holds >= 0]]


def coverage_merged(candidates: DataFrame, least: int = PIECE) -> DataFrame:
    """Words of several candidates of a document (candidate, candidate_score) folded into one, best candidate first.

    A later word replaces the first kept word that shows the same (COVERAGE: near centres suffice whatever the text), if its
    reading is strictly better by ``coverage_preference``; one that shows nothing kept is added. Lines are built anew.
    Documents are cut as in ``fused``.
    """
    words = candidates.withColumn("_score", coverage_preference(F.col("norm_text"), F.col("confidence")).cast("double"))

    def kept(words: Words, part: np.ndarray) -> np.ndarray:
        candidate = words["candidate"]
        if not isinstance(candidate, np.ndarray):
            candidate = pc.rank(candidate, tiebreaker="dense").to_numpy()
        order = _ordered(_strings(words["word_id"]), part, -words["candidate_score"].astype(float), candidate, words["word_index"])
        return coverage_places(words, part[order], order)

    return _by_piece(words, kept, least, "candidate", "candidate_score", "_score")
