"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights.

Documents become token pieces of at most ``capacity`` tokens. The covering program "minimise the number of sequences
such that every length is covered as often as it occurs" has one variable per configuration (multiset of lengths that
fits). Its dual prices, one per length, are updated multiplicatively: each round prices configurations with an
unbounded-knapsack dynamic program over the capacity, uses them on the demand, and raises the prices of lengths that
stayed uncovered. The fractional plan covers all demand; it is rounded down, and what that leaves, less than one use
of each configuration, is placed by best fit decreasing. The plan's excess over the dual bound does not grow with the corpus.

Scale. Tokens are counted once, where the text is read; from then on only (id, piece, length, crc) rows move. The
driver sees the histogram alone, at most ``capacity`` numbers whatever the corpus. Pieces of one length are numbered
with a two-level count (bucket, then rank inside the bucket), so a length that a third of all pieces share is numbered
in parallel. The plan that goes to the executors has a bounded number of segments: a small multiple of lengths x
pieces per configuration. Solving the program takes some seconds on the driver, the same for any corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import stored, text_column
from pagemill.llm.words import word_tokens

PIECES = "{id} {id_type}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of a document's ids and ``end_id``: (id, piece, start, length, ids_crc32).

    Only documents longer than ``capacity`` have several pieces; the last one may be shorter. A null text is empty
    and gives the end id alone. Null and repeated ids are carried along. tokenizer: path of a tokenizers file.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_column(text_col).alias("_text"))
    end = np.array([end_id], "<u4").tobytes()
    cut = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(tokenizer)
        for batch in batches:
            place, piece, length, crc = [], [], [], []
            for i, ids in enumerate(encode(batch.column(1))):
                data = memoryview(ids + end)
                for k, at in enumerate(range(0, len(data), cut)):
                    part = data[at : at + cut]
                    place.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            numbers = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(place, pa.int64())), pa.array(numbers.astype(np.int32)), pa.array(numbers * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = PIECES.format(id="_id", id_type=rows.schema["_id"].dataType.simpleString())
    return rows.mapInArrow(pieces, schema).withColumnRenamed("_id", id_col)


def _priced(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Knapsack over capacities 0..C with unlimited items, by dynamic programming.

    Returns at each capacity the item taken last (0: none), the next capacity at or below with one, and the greatest
    value. Of configurations worth the same those of fewer pieces are taken: they are easier to supply, and short.
    """
    top = len(value) - 1
    value = (value - 1e-6).astype(np.float32)
    best, item = np.zeros(top + 1, np.float32), np.zeros(top + 1, np.int64)
    lengths = np.flatnonzero(value > 0)
    step = int(lengths[0]) if len(lengths) else top + 1
    if len(lengths) < 400 and step >= 8:  # as many capacities at once as no item among them depends on
        known = np.full(2 * top + 1, -np.inf, np.float32)  # from the middle on: best
        known[top : top + step] = 0
        for c in range(step, top + 1, step):
            taken = known[top + np.arange(c, min(c + step, top + 1))[:, None] - lengths] + value[lengths]
            k = taken.argmax(1)
            most = np.maximum.accumulate(np.append(best[c - 1], taken[np.arange(len(k)), k]))
            here = slice(c, c + len(k))
            best[here], item[here] = most[1:], np.where(most[1:] > most[:-1], lengths[k], 0)
            known[top + c : top + c + len(k)] = best[here]
    else:
        back = np.zeros(top + 1, np.float32)  # best, reversed: the values at c-1, c-2, ..., 0 lie together
        for c in range(1, top + 1):
            taken = value[1 : c + 1] + back[top - c + 1 :]
            k = int(taken.argmax())
            if taken[k] > best[c - 1]:
                best[c], item[c] = taken[k], k + 1
            else:
                best[c] = best[c - 1]
            back[top - c] = best[c]
    filled = np.maximum.accumulate(np.where(item > 0, np.arange(top + 1), 0))
    return item, filled, float(best[top])


def _configurations(item: np.ndarray, filled: np.ndarray, *first: np.ndarray) -> list[list[int]]:
    """For each of the lengths ``first`` (or pairs of them, which must fit) the best configuration that contains it, all from one pricing."""
    left = filled[len(item) - 1 - sum(first)]
    columns = list(first)
    while (taken := item[left]).any():
        columns.append(taken)
        left = filled[left - taken]
    return [[x for x in row if x] for row in np.stack(columns, 1).tolist()]


def pack_program(counts: np.ndarray, learn: int = 6, rate: float = 0.5, passes: int = 20, pairs: int = 4, shares: tuple[float, ...] = (0.9, 0.99, 0.999, 1.0)) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """A fractional plan that covers ``counts`` (counts[l]: pieces of length l) whole, and a lower bound from its dual.

    Plan: configurations ((length, times), ...) and how often each is used, a real number. Prices start as lengths.
    Each pricing gives for every length the best configuration that holds it; lengths that the demand leaves uncovered
    become dearer by a factor exponential in the uncovered share. ``learn`` rounds do that on trial demands: prices
    over the value of the best configuration are feasible in the dual, so demand times prices is a bound, and the
    prices of the greatest bound are kept. By complementary slackness the best plans use configurations that are
    tight under these prices only. Demand is then covered share by share with tight ones, each used until one of its
    lengths runs out, so that configurations never outnumber lengths by much; what a share leaves goes to the next,
    where fillers are fresh, and the last share takes ever less tight ones as those before run out.
    """
    capacity = len(counts) - 1
    size = np.arange(capacity + 1) / capacity
    present = counts > 0
    lengths = np.flatnonzero(present)[::-1]
    plan: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    if not len(lengths):
        return plan, 0.0
    masked = lambda value, there: np.where(there, value, -np.inf)

    def used(configurations: list[list[int]], left: np.ndarray, tight: np.ndarray, least: float, into: dict | None) -> np.ndarray:
        left, tight = left.tolist(), tight.tolist()
        for config in configurations:
            if min([left[x] for x in config]) <= 1e-9 or sum([tight[x] for x in config]) < least:
                continue
            times = Counter(config)
            n = min(left[x] / m for x, m in times.items())
            for x, m in times.items():
                left[x] = left[x] - n * m if left[x] > n * m * (1 + 1e-12) else 0.0
            if into is not None:
                into[tuple(sorted(times.items(), reverse=True))] += n
        return np.array(left)

    price, dual, bound = size.copy(), size, float(counts @ size)  # lengths are feasible: no configuration is longer than a sequence
    for _ in range(learn):
        item, filled, best = _priced(masked(price, present))
        feasible = price / (best + 1e-6 * capacity + 1e-5)  # the tie-breaker took up to 1e-6 a piece, and sums are rounded
        if counts @ feasible > bound:
            dual, bound = feasible, float(counts @ feasible)
        left = used(_configurations(item, filled, lengths), counts.astype(float), price, 0.0, None)
        price = price * np.exp(rate * np.divide(left, counts, out=np.zeros(capacity + 1), where=present))

    rng = np.random.default_rng(0)
    left, done = np.zeros(capacity + 1), 0.0
    for share in shares:
        demand = left + counts * (share - done)
        left, done, weight = demand.copy(), share, np.zeros(capacity + 1)
        slack = 1e-6
        for _ in range(passes if share < 1 else 2 * len(counts)):
            there = left > 1e-9
            before = left.sum()
            if not there.any():
                break
            # Small differences vary the tight configurations that are met: larger fillers rather than many small ones, which
            # are of use anywhere, and what stays uncovered is dearer in the next pass.
            value = masked(dual * (1 + 1e-3 * (weight + 3 * size + 0.3 * rng.random(capacity + 1))), there)
            item, filled, _ = _priced(value)
            lengths = np.flatnonzero(there)[::-1]
            lengths = lengths[2 * lengths >= lengths[0]]  # short ones fill sequences of long ones before they make their own
            left = used(_configurations(item, filled, lengths), left, dual, 1 - slack, plan)
            # One pricing has few fillers; with a second length at will other tight configurations are met.
            for _ in range(pairs):
                second = rng.permutation(lengths)
                fits = lengths + second <= capacity
                left = used(_configurations(item, filled, lengths[fits], second[fits]), left, dual, 1 - slack, plan)
            weight += np.divide(left, demand, out=np.zeros(capacity + 1), where=demand > 0)
            weight /= max(1.0, weight.max())
            if left.sum() > before * 0.99:
                if share < 1:
                    break
                slack = min(1.0, slack * 4)
    return plan, bound


def pack_plan(counts: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations ((length, times), ...) and how many sequences use each; counts[l]: pieces of length l.

    The fractional plan rounded down, and best fit for what that leaves: less than one use of each configuration.
    """
    counts = counts.astype(np.int64)
    plan: dict = defaultdict(int)
    left = counts.copy()
    for config, n in pack_program(counts)[0].items():
        whole = min(int(n + 1e-6), *(int(left[x]) // m for x, m in config))
        if whole > 0:
            plan[config] += whole
            for x, m in config:
                left[x] -= whole * m
    for config, n in _best_fit(left, len(counts) - 1).items():
        plan[config] += n
    return sorted(plan.items(), reverse=True)


def _best_fit(left: np.ndarray, capacity: int) -> dict:
    """Best fit decreasing, for the pieces that rounding leaves: as many as configurations hold, whatever the corpus."""
    open_by_room: dict[int, list[list[int]]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, bool)
    for x in np.repeat(np.arange(capacity + 1), left)[::-1].tolist():
        k = int(rooms[x:].argmax()) + x
        config = open_by_room[k].pop() if rooms[k] else []
        room = k if config else capacity
        if config and not open_by_room[k]:
            rooms[k] = False
        config.append(x)
        open_by_room[room - x].append(config)
        rooms[room - x] = room - x > 0
    out: dict = defaultdict(int)
    for config in (c for cs in open_by_room.values() for c in cs):
        out[tuple((x, config.count(x)) for x in sorted(set(config), reverse=True))] += 1
    return out


def _segments(plan: list) -> dict[str, np.ndarray]:
    """The plan as runs of ordinals of each length: the i-th piece of a length goes to sequence ``first + (i - begin) // times``."""
    rows, next_sequence, used = [], 0, defaultdict(int)
    for config, n in plan:
        offset = 0
        for x, m in config:
            rows.append((x, used[x], m, next_sequence, offset))
            used[x] += n * m
            offset += x * m
        next_sequence += n
    table = np.array(rows or np.zeros((0, 5)), np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "begin", "times", "first", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = 4096, bucket_rows: int = 2000) -> DataFrame:
    """``pieces`` (id, piece, start, length, ids_crc32) with sequence_id and offset; offsets leave no gap from 0.

    Pieces of equal length are interchangeable; they are numbered by id, piece and crc, and rows equal in all of these
    in any order. An empty table gives an empty result.
    """
    id_type = pieces.schema[id_col].dataType.simpleString()
    pieces = stored(pieces.select(F.col(f"`{id_col}`").alias("_id"), "piece", "start", "length", "ids_crc32"), "pieces")
    buckets = -(-pieces.count() // bucket_rows) or 1
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counted = stored(pieces.groupBy("_bucket", "length").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for x, n in counted.groupBy("length").agg(F.sum("_n")).collect():  # at most ``capacity`` rows
        counts[x] = n
    plan = pieces.sparkSession.sparkContext.broadcast(_segments(pack_plan(counts)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("_bucket", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = Window.partitionBy("_bucket", "length").orderBy("_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("_rank", F.row_number().over(rank) - 1).join(offsets, ["_bucket", "length"])
    numbered = numbered.select("_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("_at"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = plan.value
        base = np.searchsorted(t["length"], np.arange(capacity + 2))
        key = t["length"] * (1 << 50) + t["begin"]
        for batch in batches:
            length, at = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            k = np.searchsorted(key, length * (1 << 50) + at, side="right") - 1
            assert (k >= base[length]).all()
            step = at - t["begin"][k]
            sequence, offset = t["first"][k] + step // t["times"][k], t["offset"][k] + step % t["times"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(placed, PIECES.format(id="_id", id_type=id_type) + ", sequence_id long, offset long").withColumnRenamed("_id", id_col)
