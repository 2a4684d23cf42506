"""Counting keys over a whole collection and handing every block of documents the totals of its own keys.

Documents are dealt into blocks of bounded size by a hash. A block counts its keys (64-bit hashes of n-grams,
shingles, ...) and sends them, sorted, as packed runs, one for each range of keys: after this combine a key costs about
its eight bytes, however often it occurs, and a hot key arrives once per block. A range adds up what it gets and answers
each block in the order asked, so an answer is totals alone. Nothing is broadcast and nothing of the data's size
reaches the driver; a block or range that is lost is computed again from its inputs.

With many blocks a run for each range would be too short to pay, so keys travel in levels, as radix sorting deals digits:
a node of a level stands for a group of blocks and a prefix of the range, gets runs from at most ``width`` nodes of the
level below (twice that on the last level), adds up equal keys and deals them by the next digit. Every node has about a
block's keys on every level, so rows and steps are (blocks x width x levels), where levels is the logarithm of the
number of blocks to a base of ``WIDTH``: two up to 0.5 million blocks, three up to 268 million. Answers go the same way back.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import block_count, stored, text_column

#: Runs that a block or a node sends on, at most.
WIDTH = 512
#: What a block tells: for each kind of key its sorted distinct keys and their counts.
Counted = list[tuple[np.ndarray, np.ndarray]]
#: Finishes a block: its rows and, aligned with what it counted, the totals of each kind.
Finish = Callable[[pa.Table, list[np.ndarray]], pa.Table]


def in_blocks(docs: DataFrame, id_col: str, text_col: str, *extra: Column, block_bytes: int = 4 << 20) -> tuple[DataFrame, int]:
    """Rows (_block, _id, _text, extra...) and the number of blocks; ``texts_of`` reads _text, which travels compressed.

    Rows go by a hash of id and text, so neither an id nor a text that many rows share fills a block.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_column(text_col).alias("_text"), *extra)
    blocks = block_count(rows, "_text", block_bytes)
    rows = rows.select(F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)).cast("long").alias("_block"), F.encode("_text", "utf-8").alias("_text"), *[c for c in rows.columns if c != "_text"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            texts = [len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), *batch.columns[2:]], batch.schema.names)

    return rows.mapInArrow(packed, rows.schema), blocks


def texts_of(table: pa.Table) -> list[bytes]:
    """The texts of a block in UTF-8."""
    codec = pa.Codec("zstd")
    return [codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in table.column("_text").to_pylist()]


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the low six bytes of each gap, then the rest of the gaps, nearly all zero, deflated; without their last byte if it is zero in all."""
    short = not (keys & np.uint64(255)).any()
    gaps, width = np.diff(keys >> np.uint64(8 * short), prepend=np.uint64(0)), 6 - short
    low = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return bytes([width]) + low + zlib.compress((gaps >> np.uint64(8 * width)).astype("<u4").tobytes(), 1)


def _unpacked_keys(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(data, np.uint8, width * n, 1).reshape(n, width)
    high = np.frombuffer(zlib.decompress(data[1 + width * n :]), "<u4").astype(np.uint64)
    return np.cumsum(gaps.view("<u8")[:, 0] + (high << np.uint64(8 * width)), dtype=np.uint64) << np.uint64(8 * (6 - width))


def _packed_counts(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of 1, 2, 4 or 8 bytes, which comes first, deflated."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(counts) or counts.max() < 1 << (8 * w))
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def _unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


@dataclass(frozen=True)
class Fan:
    """How keys travel: ``width`` digits on each of ``levels`` levels, so width ** levels ranges of keys."""

    levels: int
    width: int

    @classmethod
    def of(cls, blocks: int, most: int = WIDTH) -> Fan:
        ranges, levels = max(1, -(-blocks // 2)), 1
        while most**levels < ranges:
            levels += 1
        width = math.ceil(ranges ** (1 / levels))
        return cls(levels, width + (width**levels < ranges))

    def above(self, level: int, child: int) -> tuple[int, int]:
        """Of a node of ``level`` (0: a block) the group that it sends to and the first of the prefixes that it deals to."""
        group, prefix = divmod(child, self.width**level)
        return (0 if level + 1 == self.levels else group // self.width), prefix * self.width

    def dealt(self, level: int, child: int, counted: Counted) -> pa.Table:
        """A node's sorted distinct keys and counts as runs for the nodes of the next level."""
        group, first = self.above(level, child)
        out, ranges, below = [], np.uint64(self.width**self.levels), np.uint64(self.width ** (self.levels - level - 1))
        for kind, (keys, counts) in enumerate(counted):
            prefix = ((((keys >> np.uint64(32)) * ranges) >> np.uint64(32)) // below).astype(np.int64)
            cuts = np.searchsorted(prefix, first + np.arange(self.width + 1))
            for d in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[d], cuts[d + 1]
                out.append((group * self.width ** (level + 1) + first + d, child, kind, b - a, _packed_keys(keys[a:b]), _packed_counts(counts[a:b])))
        columns = list(zip(*out, strict=True)) or [()] * len(RUN)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, RUN.values(), strict=True)], list(RUN))


RUN = {"_node": pa.int64(), "_child": pa.int64(), "_kind": pa.int32(), "_n": pa.int64(), "_keys": pa.binary(), "_counts": pa.binary()}
RUN_SCHEMA = "_node long, _child long, _kind int, _n long, _keys binary, _counts binary"
ANSWER = {"_block": pa.int64(), "_range": pa.int64(), "_kind": pa.int32(), "_totals": pa.binary(), "_sum": pa.int64(), "_distinct": pa.int64()}
ANSWER_SCHEMA = "_block long, _range long, _kind int, _totals binary, _sum long, _distinct long"


class Node:
    """The runs that a node got, added up."""

    def __init__(self, table: pa.Table):
        self.at = table.column("_node")[0].as_py()
        self.children, self.kinds, self.sizes = (table.column(c).to_numpy() for c in ("_child", "_kind", "_n"))
        keys, counts = table.column("_keys").to_pylist(), table.column("_counts").to_pylist()
        #: Per kind: the rows of its runs, distinct keys, their sums, and of each key of the runs, end to end, which of the distinct ones it is.
        self.kind: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for kind in np.unique(self.kinds).tolist():
            rows = np.flatnonzero(self.kinds == kind)
            own = np.concatenate([_unpacked_keys(keys[i], int(self.sizes[i])) for i in rows.tolist()])
            n = np.concatenate([_unpacked_counts(counts[i]) for i in rows.tolist()])
            order = np.argsort(own, kind="stable")  # merges runs that are sorted already
            ordered = own[order]
            fresh = np.r_[True, ordered[1:] != ordered[:-1]]
            place = np.empty(len(own), np.int64)
            place[order] = np.cumsum(fresh) - 1
            self.kind[kind] = rows, ordered[fresh], np.add.reduceat(n[order], np.flatnonzero(fresh)), place

    def counted(self) -> Counted:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return [self.kind[k][1:3] if k in self.kind else none for k in range(int(self.kinds.max()) + 1)]

    def answers(self, totals: dict[int, np.ndarray], last: bool) -> pa.Table:
        """What each child asked, from the totals of the distinct keys; the last level also tells each kind's sums, as block -1."""
        out = []
        for kind, (rows, _, _, place) in self.kind.items():
            each = np.split(totals[kind][place], np.cumsum(self.sizes[rows])[:-1])
            out += [(int(self.children[i]), self.at, kind, _packed_counts(x), 0, 0) for i, x in zip(rows.tolist(), each, strict=True)]
            if last:
                out.append((-1, self.at, kind, b"", int(totals[kind].sum()), int((totals[kind] > 0).sum())))
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, ANSWER.values(), strict=True)], list(ANSWER))


def totals(rows: DataFrame, blocks: int, count: Callable[[pa.Table], Counted], width: int = WIDTH, answer: Callable[[Node, int], pa.Table] | None = None) -> DataFrame:
    """A stored table (_block, _range, _kind, _totals, _sum, _distinct): answers to blocks, and with _block = -1 each range's sums.

    _sum and _distinct: of a kind's counts the sum, and how many keys have a positive one. ``answer`` tells what a range
    answers, from its node and the number of ranges, where that is something else than totals.
    """
    fan = Fan.of(blocks, width)
    runs = [rows.groupBy("_block").applyInArrow(lambda t: fan.dealt(0, t.column("_block")[0].as_py(), count(t)), RUN_SCHEMA)]
    for level in range(1, fan.levels):
        runs[-1] = stored(runs[-1], "runs")  # read once more on the way back
        runs.append(runs[-1].groupBy("_node").applyInArrow(_dealer(fan, level), RUN_SCHEMA))

    def summed(table: pa.Table) -> pa.Table:
        node = Node(table)
        return answer(node, fan.width**fan.levels) if answer else node.answers({k: found[2] for k, found in node.kind.items()}, last=True)

    def passed_on(table: pa.Table, back: pa.Table) -> pa.Table:
        node = Node(table)
        return node.answers(dict(enumerate(_answered(back, int(node.kinds.max()) + 1))), last=False)

    answers = stored(runs.pop().groupBy("_node").applyInArrow(summed, ANSWER_SCHEMA), "totals")
    sums = answers.where("_block < 0")
    while runs:
        asked = answers.where("_block >= 0")
        answers = stored(runs.pop().groupBy("_node").cogroup(asked.groupBy("_block")).applyInArrow(passed_on, ANSWER_SCHEMA), "totals")
    return answers if fan.levels == 1 else answers.unionByName(sums)


def _dealer(fan: Fan, level: int) -> Callable[[pa.Table], pa.Table]:
    def deal(table: pa.Table) -> pa.Table:
        node = Node(table)
        return fan.dealt(level, node.at, node.counted())

    return deal


def _answered(back: pa.Table, kinds: int) -> list[np.ndarray]:
    """Of each kind the totals in the order of the keys that were sent."""
    kind = back.column("_kind").to_numpy()
    order, blobs = np.lexsort((back.column("_range").to_numpy(), kind)), back.column("_totals").to_pylist()
    return [np.concatenate([np.zeros(0, np.int64), *(_unpacked_counts(blobs[i]) for i in order.tolist() if kind[i] == k)]) for k in range(kinds)]


def finished(rows: DataFrame, answers: DataFrame, kinds: int, finish: Finish, schema: str) -> DataFrame:
    """Each block's rows with its totals through ``finish``, which gets them per kind in the order of the block's keys."""
    back = answers.where("_block >= 0").select("_block", "_range", "_kind", "_totals")
    return rows.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(lambda table, back: finish(table, _answered(back, kinds)), schema)
