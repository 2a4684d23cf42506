"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that occurs again anywhere are removed.

Every string of that length holds an anchor: of the hashes of its runs of GRAM bytes the least. The anchor depends on
the string alone, so equal strings have equal anchors, and strings of consecutive starts mostly share one. A run of
starts with the same anchor, with the bytes that its strings span, is a context. Anchors that occur once in the
collection (counted with ``exchange``) cannot belong to repeated strings; of the others, equal contexts are folded
with a count. A folded context with a count of two or more is repeated as a whole. Where an anchor has several
contexts, these are laid end to end, sorted into a suffix array in two stages, and starts whose neighbour shares
``length`` bytes are repeated: this compares bytes, not hashes.

Scale. Text is dealt into blocks twice; otherwise only repeated contexts travel, once each after folding. The suffixes
of an anchor whose different contexts exceed ``group_bytes`` do not fit a task, so they are partitioned: contexts are cut
into parts, laid out from the anchor so that equal strings lie in corresponding parts, and parts meet by the bytes that
all their strings share; where that still exceeds a task, smaller parts do, and in the end single strings, which are
grouped by their bytes with a map-side combine. Hashes only place and rule out; equal bytes decide everywhere.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import distinct, merged_runs, rekeyed, stored, text_column
from pagemill.llm.exchange import finished, in_blocks, texts_of, totals
from pagemill.llm.suffixes import adjacent_prefixes, hashes, suffix_array

GRAM = 32
#: Starts in a context at most, so that periodic texts do not make contexts as long as themselves.
RUN = 1024
#: Bytes of contexts that are sorted together.
BATCH = 1 << 19
#: Starts in a part of a context whose anchor's do not fit a task, then in a part of a part that still meets too many.
PARTS = (64, 8)


class Block:
    """The texts of a block end to end, and the runs of string starts that share an anchor."""

    def __init__(self, parts: list[bytes], length: int):
        gram = min(GRAM, length)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.length = length
        n = len(self.data) - length + 1
        self.starts = self.ends = np.zeros(0, np.int64)
        self.keys, self.repeats = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n <= 0:
            return
        h = gram_hashes(self.data, gram)
        least = _window_least(h, length - gram + 1)
        whole = self.sizes >= length
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, self.begins[whole], 1)
        np.add.at(inside, self.begins[whole] + self.sizes[whole] - length + 1, -1)
        inside = np.cumsum(inside[:-1]) > 0
        fresh = inside & np.r_[True, ~inside[:-1] | (least[1:] != least[:-1])]
        last = inside & np.r_[~inside[1:] | (least[1:] != least[:-1]), True]
        starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        pieces = -(-(ends - starts) // RUN)
        first = np.cumsum(pieces) - pieces
        of = np.repeat(np.arange(len(starts)), pieces)
        self.starts = starts[of] + (np.arange(len(of)) - first[of]) * RUN
        self.ends = np.minimum(self.starts + RUN, ends[of])
        self.keys = least[self.starts]
        # An anchor that the block has at two places may repeat inside one run: such a run counts twice.
        ordered = np.sort(h)
        self.repeats = np.where(np.searchsorted(ordered, self.keys, side="right") - np.searchsorted(ordered, self.keys) > 1, 2, 1)

    def counted(self) -> list[tuple[np.ndarray, np.ndarray]]:
        keys, at = np.unique(self.keys, return_inverse=True)
        return [(keys, np.bincount(at, self.repeats, len(keys)).astype(np.int64))]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    h = hashes(data, gram)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _whole_strings(begins: np.ndarray, sizes: np.ndarray, total: int, length: int) -> np.ndarray:
    """Where a string of ``length`` starts that ends inside its own piece; the pieces lie end to end, each at least that long."""
    steps = np.zeros(total + 2, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, begins + sizes - length + 1, -1)
    return np.cumsum(steps)[:total] > 0


def _window_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width``: the lesser of a suffix of one stretch and a prefix of the next."""
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, 2**64 - 1, np.uint64)
    padded[: len(h)] = h
    stretches = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(stretches, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(stretches[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])


def repeated_starts(contexts: list[bytes], counts: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose strings occur again, at another place of a context, in another one, or in a copy of it: (context, begin, end).

    Strings whose hash no other has here need no sorting; what the others span is laid end to end and sorted.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    begins = np.cumsum(sizes) - sizes
    whole = _whole_strings(begins, sizes, len(data), length)  # those of two contexts never touch
    again = np.zeros(len(data) + 2, bool)
    again[1:-1] = whole & np.repeat(np.array(counts, np.int64) > 1, sizes)
    starts = np.flatnonzero(whole)
    h = hashes(data, length)[starts]
    by = np.argsort(h)
    twin = h[by][1:] == h[by][:-1]
    starts = np.sort(starts[by[np.r_[False, twin] | np.r_[twin, False]]]) if len(by) else starts
    if len(starts):
        a, b = merged_runs(starts, starts + length)
        widths = b - a
        places = np.repeat(a - (np.cumsum(widths) - widths), widths) + np.arange(widths.sum())
        wanted = np.zeros(len(data), bool)
        wanted[starts] = True
        text = data[places]
        order = suffix_array(text, length)
        order = order[wanted[places[order]]]  # equal strings stay neighbours
        same = adjacent_prefixes(text, order, length) >= length
        again[1 + places[order[same | np.append(same[1:], False)]]] = True
    edges = np.flatnonzero(again[1:] != again[:-1])
    starts, ends = edges[::2], edges[1::2]
    of = np.searchsorted(begins, starts, side="right") - 1
    return of, starts - begins[of], ends - begins[of]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, digest: bool = False, group_bytes: int = 1 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, n_removed, n_spans, kept_sha256), or with digest=False (id, kept binary, spans).

    Texts are UTF-8 bytes; strings never cross rows; overlapping and self-overlapping occurrences count; all strings are
    judged on the input. spans: maximal removed runs as (begin, end) bytes. Null and empty texts have nothing removed. Null
    and repeated ids are carried along: rows are told apart by id and text, and equal rows are copies of each other.
    Texts shorter than ``length`` stay whole. Other columns are not read; an empty table gives an empty result.
    """
    rows, blocks = in_blocks(docs, id_col, text_col, F.xxhash64(text_column(text_col)).alias("_hash"), block_bytes=block_bytes)
    id_type = rows.schema["_id"].dataType.simpleString()
    block_of = lambda t: Block(texts_of(t), length)
    answers = totals(rows, blocks, lambda t: block_of(t).counted())

    def contexts(table: pa.Table, found: list[np.ndarray]) -> pa.Table:
        block = block_of(table)
        keys = distinct(block.keys)
        kept = np.flatnonzero(found[0][np.searchsorted(keys, block.keys)] > 1) if len(keys) else np.zeros(0, np.int64)
        starts, ends = block.starts[kept], block.ends[kept]
        doc = np.searchsorted(block.begins + block.sizes, starts, side="right")
        raw = block.data.tobytes()
        cut = [raw[a : b - 1 + length] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        take = pa.array(doc)
        return pa.Table.from_arrays([table.column("_block").take(take), table.column("_id").take(take), table.column("_hash").take(take), pa.array(starts - block.begins[doc]), pa.array(block.keys[kept].view(np.int64)), pa.array(cut, pa.binary())], ["_block", "_id", "_hash", "_at", "_key", "_context"])

    seen = finished(rows, answers, 1, contexts, f"_block long, _id {id_type}, _hash long, _at long, _key long, _context binary")
    seen = stored(seen, "contexts")
    folded = stored(seen.groupBy("_key", "_context").agg(F.count(F.lit(1)).alias("_n")), "folded")
    variants = folded.groupBy("_key").agg(F.count(F.lit(1)).alias("_variants"), F.sum(F.octet_length("_context")).alias("_bytes")).select(rekeyed("_key").alias("_k"), "_variants", "_bytes")
    folded = folded.join(variants.hint("merge"), rekeyed("_key") == F.col("_k")).select("_key", "_context", "_n", "_variants", "_bytes")
    marks = [F.xxhash64("_context").alias("_c1"), F.xxhash64("_context", F.lit(1)).alias("_c2")]

    folded = stored(folded, "variants")
    marked = lambda where: folded.where(where).select("_key", "_context", "_n", F.xxhash64("_context").alias("_c1"), F.xxhash64("_context", F.lit(1)).alias("_c2"))

    def sorted_in_batch(table: pa.Table) -> pa.Table:
        of, begin, end = repeated_starts(table.column("_context").to_pylist(), table.column("_n").to_pylist(), length)
        columns = [table.column(c).take(pa.array(of)) for c in ("_key", "_c1", "_c2")]
        offset = table.column("_offset").to_numpy()[of]
        return pa.Table.from_arrays([*columns, pa.array(begin + offset), pa.array(end + offset)], ["_key", "_c1", "_c2", "_from", "_to"])

    schema = "_key long, _c1 long, _c2 long, _from long, _to long"
    def sorted_by(groups: DataFrame, *group: str) -> DataFrame:
        size = groups.agg(F.sum(F.octet_length("_context"))).first()[0] or 0
        batch = F.pmod(F.xxhash64(*group), F.lit(max(8, -(-size // BATCH)))).cast("int").alias("_batch")
        return groups.select("_key", "_context", "_n", "_c1", "_c2", "_offset", batch).groupBy("_batch").applyInArrow(sorted_in_batch, schema)

    # Contexts of which there are copies but no variants are repeated as a whole.
    found = marked("_variants = 1 AND _n > 1").select("_key", "_c1", "_c2", F.lit(0).cast("long").alias("_from"), (F.octet_length("_context") - length + 1).cast("long").alias("_to"))
    few = marked(f"(_variants > 1 OR _n = 1) AND (_bytes <= {group_bytes} OR _variants = 1)").withColumn("_offset", F.lit(0).cast("long"))
    found = found.unionByName(sorted_by(few, "_key"))
    rest = marked(f"_variants > 1 AND _bytes > {group_bytes}")
    for part in PARTS:
        parts = stored(_core_groups(rest, length, part), "parts")
        found = found.unionByName(sorted_by(parts.where(f"_bytes <= {group_bytes}"), "_d1", "_d2"))
        rest = parts.where(f"_bytes > {group_bytes}")
    strings = _cut(rest, length, 1).select("_key", "_context", "_n", "_c1", "_c2", "_offset")
    again = strings.groupBy("_context").agg(F.sum("_n").alias("_sum")).where("_sum > 1").select(F.base64("_context").alias("_string"))
    again = strings.join(again.hint("merge"), F.base64("_context") == F.col("_string"))
    found = found.unionByName(again.select("_key", "_c1", "_c2", F.col("_offset").alias("_from"), (F.col("_offset") + 1).alias("_to")))
    found = stored(_runs_of_contexts(found), "repeats")

    places = seen.select("_block", "_id", "_hash", "_at", "_key", *marks)
    hits = places.join(found.hint("merge"), ["_key", "_c1", "_c2"]).select("_block", "_id", "_hash", "_at", "_runs")

    def removed(table: pa.Table, spans: pa.Table) -> pa.Table:
        own: dict = defaultdict(list)
        columns = [spans.column(c).to_pylist() for c in ("_id", "_hash")]
        runs = spans.column("_runs").combine_chunks()
        sizes, each = runs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), runs.flatten()
        last = np.cumsum(sizes).tolist()
        for a, b, key in zip([0, *last], last, zip(*columns, strict=True), strict=False):
            own[key].extend(range(a, b))
        at_of = np.repeat(spans.column("_at").to_numpy(), sizes)
        begin, end = at_of + each.field("_from").to_numpy(), at_of + each.field("_to").to_numpy() - 1 + length
        out = []
        for key in zip(*(table.column(c).to_pylist() for c in ("_id", "_hash")), texts_of(table), strict=True):
            data, at = key[2], own.get(key[:2], [])
            a, b = merged_runs(begin[at], end[at]) if at else (np.zeros(0, np.int64),) * 2
            a, b = a.tolist(), b.tolist()
            kept = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)], strict=True)) if a else data
            out.append((len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest()) if digest else (kept, [{"begin": x, "end": y} for x, y in zip(a, b, strict=True)]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string()) if digest else (pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.Table.from_arrays([table.column("_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["_id", *(("n_bytes", "n_removed", "n_spans", "kept_sha256") if digest else ("kept", "spans"))]
    types = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "kept binary, spans array<struct<begin:long,end:long>>"
    return rows.groupBy("_block").cogroup(hits.groupBy("_block")).applyInArrow(removed, f"_id {id_type}, {types}").withColumnRenamed("_id", id_col)


def _runs_of_contexts(found: DataFrame) -> DataFrame:
    """(_key, _c1, _c2, _runs): of each context the maximal runs of its repeated starts, of which there may be one a start.

    So a place meets one row, and a context with many copies and many repeated starts doesn't meet them one by one.
    """
    context = ["_key", "_c1", "_c2"]
    order = Window.partitionBy(*context).orderBy("_from", "_to")
    reached = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("_fresh", F.coalesce((F.col("_from") > reached).cast("int"), F.lit(0)))
    marked = marked.withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*context, "_run").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    return runs.groupBy(*context).agg(F.collect_list(F.struct("_from", "_to")).alias("_runs"))


def _core_groups(contexts: DataFrame, length: int, part: int) -> DataFrame:
    """Contexts cut into parts of ``part`` starts, those that may hold repeated strings.

    Parts meet under a 128-bit hash (_d1, _d2) of the bytes that all strings of a part share; _bytes adds up those that do.
    Parts that meet no other and stand for one occurrence are left out.
    """
    each = _cut(contexts, length, part)
    groups = each.groupBy("_d1", "_d2").agg(F.sum("_n").alias("_sum"), F.sum(F.octet_length("_context")).alias("_bytes")).where("_sum > 1")
    groups = groups.select(rekeyed("_d1").alias("_e1"), rekeyed("_d2").alias("_e2"), "_bytes")
    return each.join(groups.hint("merge"), (rekeyed("_d1") == F.col("_e1")) & (rekeyed("_d2") == F.col("_e2"))).drop("_e1", "_e2")


def _cut(contexts: DataFrame, length: int, part: int) -> DataFrame:
    """Contexts (_key, _context, _n, _c1, _c2[, _offset]) as parts of ``part`` starts, laid out from the anchor, so equal strings of two contexts are in corresponding parts."""
    if "_offset" not in contexts.columns:
        contexts = contexts.withColumn("_offset", F.lit(0).cast("long"))
    gram = min(GRAM, length)

    def cut(batches):
        for batch in batches:
            pieces = batch.column(1).to_pylist()
            raw = b"".join(pieces)
            data, sizes = np.frombuffer(raw, np.uint8), np.array([len(c) for c in pieces], np.int64)
            begins = np.cumsum(sizes) - sizes
            starts = np.flatnonzero(_whole_strings(begins, sizes, len(data), length))
            of = np.searchsorted(begins, starts, side="right") - 1
            keys = batch.column(0).to_numpy().view(np.uint64)
            h = gram_hashes(data, gram)
            anchors = np.flatnonzero(h == np.repeat(keys, sizes)[: len(h)])
            anchor = anchors[np.searchsorted(anchors, starts)] if len(starts) else starts
            which = (anchor - starts) // part
            fresh = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1]) | (of[1:] != of[:-1])]) if len(starts) else starts
            first, last = starts[fresh], starts[np.append(fresh[1:], len(starts)) - 1] if len(starts) else starts
            core, core_end = (anchor - which * part)[fresh], (anchor - which * part + max(0, length + 1 - part))[fresh]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(core.tolist(), core_end.tolist(), strict=True)), np.int64).reshape(-1, 2)
            take = pa.array(of[fresh])
            cuts = pa.array([raw[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
            offsets = batch.column(5).to_numpy()[of[fresh]] + first - begins[of[fresh]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), cuts, *(batch.column(k).take(take) for k in (2, 3, 4)), pa.array(offsets), pa.array(digest[:, 0]), pa.array(digest[:, 1])], ["_key", "_context", "_n", "_c1", "_c2", "_offset", "_d1", "_d2"])

    return contexts.select("_key", "_context", "_n", "_c1", "_c2", "_offset").mapInArrow(cut, "_key long, _context binary, _n long, _c1 long, _c2 long, _offset long, _d1 long, _d2 long")
