"""N-gram Jaccard join with skipping by set relations, down to the connected components of its links.

Candidates. Shingles are 64-bit hashes. In a global order a set of n shingles must share one of its first
n - ceil(t n) + 1 with every set that is as similar as t (prefix filter). The order puts shingles of a fixed quarter
of the hash space first, rarest first, and the others after them by hash: the quarter's document frequencies are
counted exactly (``exchange``), and a shingle that no other document has needs no index entry, so ordinary documents
have none at all. Sets meet under a shingle in classes of size a factor of t wide; similar sets are in the same or
adjacent classes. Each entry is tied to its list's first set, which leaves as many ties as entries; components of the
ties hold all candidates together.

Join. Inside such a candidate group the lists are inverted again, locally, with entries in the order of size. Index
skipping: of each list only the block of positions whose sizes are within the bound is read, between two searched
positions. Answer skipping: the overlaps of a set R with those after it are derived from those of the most similar set P done before, by subtracting the lists of
P minus R and adding those of R minus P; rows of overlaps go once no set to come has theirs as its P. Groups too large
for a task, in shingles or in sets, are dealt into chunks by size class and hash, and each pair of chunks of the same
or adjacent classes is a task: every pair of sets is compared somewhere.

Scale. Equal sets are folded first, so a group of copies is one set. A set so small that one shingle more or less breaks
the bound links with no other set and needs no entry. A task returns a spanning forest of its links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import distinct, mix64, rekeyed, stored
from pagemill.llm.components import components
from pagemill.llm.exchange import finished, in_blocks, texts_of, totals

#: Shingles below this hash are counted: a quarter of them.
COUNTED = np.uint64(1 << 62)
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Shingles and sets in a chunk of a large candidate group.
CHUNK = 200_000
SETS = 2_000
#: Shingles in a batch of tasks, and sets between two releases of overlap rows.
BATCH = 500_000
RELEASE = 64
#: Bytes of overlap rows that a task holds.
ROWS = 32 << 20


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of ``width`` words; of fewer words one for all; of none an empty array.

    Texts are UTF-8. Words: A-Z lowered, parted by ASCII white space.
    """
    lists = [x.lower().split() for x in texts]
    words = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    seq = hashes[words.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64)
    steps = np.resize(STEPS, width)

    def joined(part: np.ndarray, n: int) -> np.ndarray:
        total = np.full(max(0, len(part) - n + 1), n, np.uint64)
        for k in range(n):
            total = mix64(total * steps[k] + part[k : len(part) - n + 1 + k])
        return total

    grams, out, at = joined(seq, width), [], 0
    for ws in lists:
        n = len(ws)
        out.append(distinct(grams[at : at + n - width + 1] if n >= width else joined(seq[at : at + n], n) if n else seq[:0]))
        at += n
    return out


def _prefix(shingles: np.ndarray, found: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """The part of a set's prefix that other documents may share."""
    n = len(shingles)
    length = n - (percent * n + 99) // 100 + 1
    counted = shingles[: np.searchsorted(shingles, COUNTED)]
    often = found["n"][np.searchsorted(found["keys"], counted)]
    order = np.argsort(often, kind="stable")[:length]
    return np.concatenate([counted[order][often[order] > 1], shingles[len(counted) : len(counted) + length - len(order)]])


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id).

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest
    id that links reach. Rows without words have no shingles and link with nothing; null texts are such rows. Ids are
    numbers; rows that share one are a single vertex; a null id has a null component. Other columns are not read. An
    empty table gives an empty result. percent: 1 to 100.
    """
    ratio = percent / 100
    step = -math.log(ratio) + 1e-9 if percent < 100 else 1e-3
    rows, blocks = in_blocks(docs, id_col, text_col, block_bytes=block_bytes)
    sets_of = lambda t: shingle_sets(texts_of(t), width)

    def counted(sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [np.unique(np.concatenate([np.zeros(0, np.uint64), *(s[: np.searchsorted(s, COUNTED)] for s in sets)]), return_counts=True)]

    answers = totals(rows, blocks, lambda t: counted(sets_of(t)))

    def finish(table: pa.Table, back: list[np.ndarray]) -> pa.Table:
        sets = sets_of(table)
        found = {"keys": counted(sets)[0][0], "n": back[0]}
        prefixes = [_prefix(s, found, percent) if len(s) else s for s in sets]
        signs = np.array([(int(np.bitwise_xor.reduce(mix64(s ^ STEPS[0]))), int(mix64(s).sum(dtype=np.uint64))) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
        n = np.array([len(s) for s in sets], np.int64)
        size = (np.log(np.maximum(n, 1)) / step).astype(np.int32)
        blobs = [p.tobytes() for p in prefixes]
        whole = [s.tobytes() if len(p) else None for s, p in zip(sets, prefixes, strict=True)]
        return pa.Table.from_arrays([table.column("_id"), pa.array(n), pa.array(size), pa.array(signs[:, 0]), pa.array(signs[:, 1]), pa.array(blobs, pa.binary()), pa.array(whole, pa.binary())], names)

    names = ["_id", "_n", "_class", "_s1", "_s2", "_prefix", "_set"]
    id_type = rows.schema["_id"].dataType.simpleString()
    sets = stored(finished(rows, answers, 1, finish, f"_id {id_type}, _n long, _class int, _s1 long, _s2 long, _prefix binary, _set binary"), "sets")

    # One set for all rows with the same; its name is their smallest id.
    indexed = sets.where("length(_prefix) > 0 AND _id IS NOT NULL")
    folded = stored(indexed.groupBy("_n", "_class", "_s1", "_s2").agg(F.min("_id").alias("_rep")), "folded")
    own = folded.select(F.col("_s1").alias("_k1"), F.col("_s2").alias("_k2"), F.col("_rep"))
    first = indexed.where(100 * F.col("_n") >= percent * (F.col("_n") + 1)).join(own, (F.col("_s1") == F.col("_k1")) & (F.col("_s2") == F.col("_k2")) & (F.col("_id") == F.col("_rep")))
    # Rows that share an id but not their text give several sets of one name; all stay, as one vertex.
    members = stored(first.select("_rep", "_n", "_class", "_prefix", "_set", "_s1", "_s2").dropDuplicates(["_rep", "_n", "_s1", "_s2"]).drop("_s1", "_s2"), "members")
    links = _links(members, percent, id_type)
    found = folded.join(components(links), F.col("_rep") == F.col("vertex"), "left").select(F.col("_s1").alias("_k1"), F.col("_s2").alias("_k2"), F.col("_n").alias("_m"), F.coalesce("component", "_rep").alias("_component"))
    out = sets.select("_id", "_n", "_s1", "_s2").join(found, (F.col("_s1") == F.col("_k1")) & (F.col("_s2") == F.col("_k2")) & (F.col("_n") == F.col("_m")), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id")).alias("component_id"))


def _placed(members: DataFrame, id_type: str) -> DataFrame:
    """``members`` in all tasks (_group, _task) of theirs, dealt into batches."""

    def entries(batches):
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            sizes = np.array([len(b) // 8 for b in blobs], np.int64)
            take = pa.array(np.repeat(np.arange(len(blobs)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(blobs), np.int64)), batch.column(1).take(take), batch.column(0).take(take)], ["_token", "_class", "_rep"])

    postings = members.select("_rep", "_class", "_prefix").mapInArrow(entries, f"_token long, _class int, _rep {id_type}")
    lists = stored(postings.groupBy("_token", "_class").agg(F.min("_rep").alias("_first"), F.count(F.lit(1)).alias("_entries")), "lists")
    several = lists.where("_entries > 1").select(F.col("_token").alias("_k"), F.col("_class").alias("_c"), "_first")
    ties = postings.join(several, (F.col("_token") == F.col("_k")) & (F.col("_class") == F.col("_c"))).select(F.col("_rep").alias("a"), F.col("_first").alias("b"))
    above = lists.select(F.col("_token"), (F.col("_class") - 1).alias("_class"), F.col("_first").alias("_next"))
    ties = ties.unionByName(lists.join(above, ["_token", "_class"]).select(F.col("_first").alias("a"), F.col("_next").alias("b")))
    groups = components(ties.where("a != b").distinct(), label="_group")

    sized = stored(members.select("_rep", "_n", "_class").join(groups, F.col("_rep") == F.col("vertex")).select("_group", "_class", "_rep", "_n"), "grouped")
    cells = sized.groupBy("_group", "_class").agg(F.sum("_n").alias("_sum"), F.count(F.lit(1)).alias("_sets"))
    totals_ = cells.groupBy("_group").agg(((F.sum("_sum") <= 2 * CHUNK) & (F.sum("_sets") <= 2 * SETS)).alias("_small"))
    dealt = F.greatest(F.ceil(F.col("_sum") / CHUNK), F.ceil(F.col("_sets") / SETS))
    cells = cells.join(totals_, "_group").withColumn("_chunks", F.when(F.col("_small"), F.lit(1)).otherwise(dealt).cast("int"))
    cells = stored(cells.select("_group", "_class", "_small", "_chunks", "_sum"), "group-cells")
    beside = lambda d, name: cells.select("_group", (F.col("_class") - d).alias("_class"), F.col("_chunks").alias(name))
    cells = cells.join(beside(1, "_above"), ["_group", "_class"], "left").join(beside(-1, "_below"), ["_group", "_class"], "left")
    copies = F.when(F.col("_small"), F.lit(1)).otherwise(F.col("_chunks") + F.coalesce("_above", F.lit(0)) + F.coalesce("_below", F.lit(0)))
    batches = max(8, -(-(cells.agg(F.sum(F.col("_sum") * copies)).first()[0] or 0) // BATCH))
    cells = cells.select(rekeyed("_group").alias("_k"), rekeyed("_class").alias("_c"), "_small", "_chunks", F.coalesce("_above", F.lit(0)).alias("_above"), F.coalesce("_below", F.lit(0)).alias("_below"))
    placed = sized.join(cells, (rekeyed("_group") == F.col("_k")) & (rekeyed("_class") == F.col("_c"))).withColumn("_own", F.pmod(F.xxhash64("_rep"), "_chunks").cast("int"))
    task = lambda k, c, l, d: F.struct(k.alias("k"), c.alias("c"), l.alias("l"), d.alias("d"))
    k, c, upto = F.col("_class"), F.col("_own"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = F.array().cast("array<struct<k:int,c:int,l:int,d:int>>")
    tasks = F.concat(
        F.transform(upto("_chunks"), lambda j: task(k, F.least(c, j), k, F.greatest(c, j))),
        F.when(F.col("_above") > 0, F.transform(upto("_above"), lambda j: task(k, c, k + 1, j))).otherwise(none),
        F.when(F.col("_below") > 0, F.transform(upto("_below"), lambda j: task(k - 1, j, k, c))).otherwise(none),
    )
    zero = F.lit(0)
    placed = placed.withColumn("_task", F.explode(F.when(F.col("_small"), F.array(task(zero, zero, zero, zero))).otherwise(tasks)))
    return placed.select("_rep", "_group", "_task", F.pmod(F.xxhash64("_group", "_task"), F.lit(batches)).cast("int").alias("_batch"))


def _links(members: DataFrame, percent: int, id_type: str) -> DataFrame:
    """Edges (a, b) that span the same components as all links between ``members``."""
    work = _placed(members, id_type).join(members.select("_rep", "_set"), "_rep")
    edges = work.select("_batch", "_group", "_rep", "_task.*", "_set").groupBy("_batch").applyInArrow(lambda t: _joined(t, percent), f"a {id_type}, b {id_type}")
    return stored(edges, "links")


def _joined(table: pa.Table, percent: int) -> pa.Table:
    """Spanning edges of the links inside each task of a batch."""
    keys = [table.column(c).to_numpy() for c in ("d", "l", "c", "k", "_group")]
    order = np.lexsort(keys)
    keys = np.stack([k[order] for k in keys])
    reps, blobs = table.column("_rep").to_numpy()[order], table.column("_set").take(pa.array(order)).to_pylist()
    starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]) if len(reps) else np.zeros(0, np.int64)
    edges: list[tuple[int, int]] = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(reps)], strict=True):
        if b - a > 1:
            names = reps[a:b].tolist()
            edges += [(names[i], names[j]) for i, j in spanning_links([np.frombuffer(x, np.uint64) for x in blobs[a:b]], percent)]
    kind = table.schema.field("_rep").type
    return pa.Table.from_arrays([pa.array([e[0] for e in edges], kind), pa.array([e[1] for e in edges], kind)], ["a", "b"])


class Lists:
    """Inverted lists of ``sets``, which are in order of size, so that a list's entries are too: a bound on sizes is a block of positions."""

    def __init__(self, sets: list[np.ndarray]):
        self.count, self.read = len(sets), 0
        sizes = np.array([len(s) for s in sets], np.int64)
        tokens, local = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        offsets = np.cumsum(sizes) - sizes
        shared = np.bincount(local, minlength=len(tokens)) > 1  # what a single set holds adds to no overlap
        #: Of each set the tokens that others hold too.
        self.held = [(x := local[o : o + n])[shared[x]] for o, n in zip(offsets.tolist(), sizes.tolist(), strict=True)]
        lengths = np.array([len(x) for x in self.held], np.int64)
        #: All entries as (token, set), sorted.
        self.entries = np.sort(np.concatenate([np.zeros(0, np.int64), *self.held]) * self.count + np.repeat(np.arange(self.count), lengths))

    def block(self, tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """The sets low..high-1 in the lists of ``tokens``, one after the other; only this block of each list's positions is read."""
        begin, end = np.searchsorted(self.entries, tokens * self.count + low), np.searchsorted(self.entries, tokens * self.count + high)
        n = end - begin
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        self.read += total
        return self.entries[np.arange(total) + np.repeat(begin - (ends - n), n)] % self.count


def _added(ids: list[np.ndarray], weights: list[np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in low..high-1, sorted, with their summed weights where these are positive."""
    at, weight = np.concatenate(ids), np.concatenate(weights)
    if len(at) < (high - low) // 16:
        found, inverse = np.unique(at, return_inverse=True)
        total = np.bincount(inverse, weight, len(found))
        return found[total > 0], total[total > 0].astype(np.int64)
    total = np.bincount(at - low, weight, high - low)
    found = np.flatnonzero(total > 0)
    return found + low, total[found].astype(np.int64)


def spanning_links(sets: list[np.ndarray], percent: int, lists: list[Lists] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (i, j) of ``sets`` with 100 |i and j| >= percent |i or j|. lists: gets the lists that were read.

    Memory: the lists, one row of overlaps at a time, and at most ROWS bytes of rows that later sets may derive theirs from.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    index = Lists([sets[i] for i in order])
    if lists is not None:
        lists.append(index)
    held = index.held
    # Sets further on are not smaller; those past what the size bound allows are in no block that is read.
    stops = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    stored_bytes = 0
    nearest, best = np.full(len(order), -1), np.zeros(len(order), np.int64)
    root = np.arange(len(order))
    forest = []
    for r in range(len(order)):
        if r % RELEASE == 0:
            needed = np.zeros(len(order) + 1, bool)  # the last: nearest to none
            needed[nearest[r:]] = True
            rows = {k: row for k, row in rows.items() if needed[k]}
            stored_bytes = sum(ids.nbytes + n.nbytes for ids, n in rows.values())
        low, high, p = r + 1, int(stops[r]), int(nearest[r])
        if high <= low or not len(held[r]):
            continue
        if p in rows and len(held[p]) + len(held[r]) - 2 * best[r] < len(held[r]):
            # P's answers as far as they go, less what only P holds, plus what only R holds; R's own lists beyond.
            gone, new = np.setdiff1d(held[p], held[r], assume_unique=True), np.setdiff1d(held[r], held[p], assume_unique=True)
            middle = min(max(low, int(stops[p])), high)
            known = slice(*np.searchsorted(rows[p][0], (low, middle)))
            ids = [rows[p][0][known], index.block(gone, low, middle), index.block(new, low, middle), index.block(held[r], middle, high)]
            weights = [rows[p][1][known], np.full(len(ids[1]), -1), np.ones(len(ids[2])), np.ones(len(ids[3]))]
        else:
            ids = [index.block(held[r], low, high)]
            weights = [np.ones(len(ids[0]))]
        met, both = _added(ids, weights, low, high)
        found = met[100 * both >= percent * (sizes[r] + sizes[met] - both)]
        for s in found[root[found] != root[r]].tolist():
            if root[s] != root[r]:
                forest.append((int(order[r]), int(order[s])))
                root[root == root[s]] = root[r]
        closer = both > best[met]
        if closer.any():
            nearest[met[closer]], best[met[closer]] = r, both[closer]
            rows[r] = met.astype(np.int32), both.astype(np.int32)
            stored_bytes += 2 * rows[r][0].nbytes
            while stored_bytes > ROWS:  # whoever would have derived from the oldest reads its own lists
                ids, n = rows.pop(next(iter(rows)))
                stored_bytes -= ids.nbytes + n.nbytes
    return forest
