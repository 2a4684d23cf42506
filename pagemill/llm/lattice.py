"""Embedding near-dedup by lattice hashing: E8 cells of random projections, probing of neighbouring cells, exact cosine.

In each of ``tables`` tables a unit vector is projected to eight dimensions and decoded to the nearest point of the E8
lattice, its home cell. It also probes the ``probes`` neighbouring cells whose points are nearest to its projection. Two
vectors meet in a table if one's home is the other's home or probe; those that meet are compared by their cosine in
double precision, so nothing below the threshold is linked.

Whole results. Identical vectors are folded into one that counts for all of them. A pair may meet in several cells; it
is counted in one of them, which both codes determine, so link counts need neither a list of pairs nor a distinct. A
cell with very many vectors is dealt into chunks and every pair of chunks is a task of its own: no cap on members.

Scale. Cells are first grouped as (cell, id) rows with counts, and vectors travel only to cells where they can meet
somebody. Batches of tasks follow the rows after repetition by chunks, and near pairs are counted block by block, so
memory depends on neither a cell's size nor the number of links. A task returns a link count per vector and a spanning
forest, linear in its members. ``scale`` shrinks the cells; scale and tables follow from the number of vectors, so that
cells stay small as a collection grows and the chance of a pair at the threshold to meet stays at ``recall``.
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import mix64, rekeyed, stored
from pagemill.llm.components import components

CHUNK = 1024
#: Placed rows in a batch of tasks, and near pairs that a task holds at once.
BATCH = 8_000
PAIRS = 20_000


#: Scales to choose from, pairs in a simulation, and what comparing a pair costs against placing a row.
SCALES = (0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.5, 1.7, 2.0, 2.3, 2.6)
SIMULATED = 10_000
COMPARED = 0.02


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even_integers(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where rounding gives an odd one, the worst-rounded entry goes the other way."""
    r = np.rint(y)
    off = y - r
    rows = np.flatnonzero(r.sum(1) % 2)
    worst = np.abs(off[rows]).argmax(1)
    r[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return r


def e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8: the better of even-sum integers and the same shifted by one half."""
    a, b = _even_integers(y), _even_integers(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@cache
def meeting(scale: float, cosine: float, probes: int) -> float:
    """The chance of two vectors at this cosine to meet in a table, by simulation, less two standard deviations.

    Their projections are Gaussian with this correlation, whatever the dimension.
    """
    rng = np.random.default_rng(0)
    a, other = rng.standard_normal((2, SIMULATED, 8)) * scale
    cells = [_points(y, probes) for y in (a, cosine * a + np.sqrt(1 - cosine**2) * other)]
    met = [(cells[i] == cells[1 - i][:, :1]).all(2).any(1) for i in (0, 1)]
    p = float((met[0] | met[1]).mean())
    return p - 2 * np.sqrt(p * (1 - p) / SIMULATED)


def fitted(n: int, cosine: float, recall: float, probes: int) -> tuple[int, float]:
    """Tables and scale by which pairs at ``cosine`` meet with a chance of ``recall``, at the least work for ``n`` vectors.

    Of a vector, a table costs its rows and the vectors it meets by chance, which are n times a probability: unrelated
    projections differ by a Gaussian of twice the variance, whose density at zero is that of falling into one cell of volume 1.
    """
    best = None
    for scale in SCALES:
        p = meeting(scale, min(cosine, 1.0), probes)
        if p <= 0:
            break
        tables = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - p)))) if p < 1 else 1
        work = tables * (1 + probes + COMPARED * n * (1 + 2 * probes) * (4 * np.pi * scale**2) ** -4)
        best = min(best or (work, tables, scale), (work, tables, scale))
    return best[1:]


def _points(y: np.ndarray, probes: int) -> np.ndarray:
    """[n, 1 + probes, 8]: the nearest lattice point of each row, then the neighbouring ones that are nearest to it."""
    home, near = e8(y), neighbours()
    best = np.argsort(-((y - home) @ near.T), axis=1, kind="stable")[:, :probes]
    return np.concatenate([home[:, None], home[:, None] + near[best]], axis=1)


class Lattice:
    def __init__(self, tables: int, probes: int, scale: float, seed: int):
        self.tables, self.probes, self.scale, self.seed = tables, probes, scale, seed

    @cache  # noqa: B019
    def projections(self, dim: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dim]).standard_normal((self.tables, dim, 8)) * self.scale

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """[n, tables, 1 + probes] hashes of each vector's home and probed cells."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), np.uint64)
        for t, g in enumerate(self.projections(unit.shape[1])):
            points = _points(unit @ g, self.probes)
            h = np.full(points.shape[:2], unit.shape[1] * 1_000_003 + t, np.uint64)
            for i in range(8):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + (2 * points[..., i]).astype(np.int64).astype(np.uint64))
            out[:, t] = h
        return out

    def counted_in(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The cell in which a pair counts, of the pairs of rows of two [n, tables, 1 + probes] arrays: in the first table where they meet, the smaller cell."""
        top = np.uint64(2**64 - 1)
        of_a = np.where((b == a[:, :, :1]).any(2), a[:, :, 0], top)
        of_b = np.where((a == b[:, :, :1]).any(2), b[:, :, 0], top)
        cell = np.minimum(of_a, of_b)
        return cell[np.arange(len(cell)), (cell != top).argmax(1)]


def _units(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of extreme values stay finite
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.97, tables: int | None = None, probes: int = 4, scale: float | None = None, seed: int = 11) -> DataFrame:
    """One row per row of ``vectors``: (id, n_links, component_id, kept).

    Links are pairs of rows with cosine of at least ``threshold`` that meet in a table. Vectors that are null, empty,
    zero, hold null or non-finite components, or have no id link with nothing: no links and a component of their own.
    So do vectors of different lengths. Ids are numbers; rows that share an id are one vertex for component_id.
    component_id: the smallest id that links reach; kept: it is the row's own. Ties at the threshold are linked.
    recall: the chance of a pair at the threshold to meet, nearer ones have a greater one; from it and the number of
    different vectors follow tables and scale, unless both are given.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    good = F.coalesce((F.size("_v") > 0) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0) & F.col("_id").isNotNull(), F.lit(False))
    usable = rows.where(good)
    folded = stored(usable.groupBy("_v").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n")), "vectors")
    if tables is None or scale is None:
        tables, scale = fitted(folded.count(), threshold, recall, probes)
    lattice = Lattice(tables, probes, scale, seed)

    def celled(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                cells = lattice.cells(_units(part.column(1)))
                n, each = len(cells), cells.shape[1] * cells.shape[2]
                home = np.broadcast_to(np.arange(cells.shape[2]) == 0, cells.shape).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1).view(np.int64)), pa.array(home), part.column(0).take(pa.array(np.repeat(np.arange(n), each)))], ["_cell", "_home", "_rep"])

    id_type = folded.schema["_rep"].dataType.simpleString()
    members = stored(folded.select("_rep", "_v").mapInArrow(celled, f"_cell long, _home boolean, _rep {id_type}"), "cells")
    shared = members.groupBy("_cell").agg(F.count(F.lit(1)).alias("_m"), F.max("_home").alias("_any")).where("_m > 1 AND _any")
    shared = stored(shared.select(rekeyed("_cell").alias("_k"), "_m", F.ceil(F.col("_m") / CHUNK).cast("int").alias("_chunks")), "shared")
    placed = members.withColumn("_k", rekeyed("_cell")).join(shared, "_k").withColumn("_own", F.pmod(F.xxhash64("_rep"), "_chunks").cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    placed = placed.select("_cell", "_home", "_rep", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    batches = max(8, -(-(shared.agg(F.sum(F.col("_m") * F.col("_chunks"))).first()[0] or 0) // BATCH))
    tasks = placed.join(folded, "_rep").withColumn("_batch", F.pmod(F.xxhash64("_cell", "_i", "_j"), F.lit(batches)).cast("int"))

    def verified(table: pa.Table) -> pa.Table:
        return _verified(table, lattice, threshold)

    found = stored(tasks.groupBy("_batch").applyInArrow(verified, "_edge boolean, _a long, _b long"), "links")
    links = found.where("NOT _edge").groupBy("_a").agg(F.sum("_b").alias("_links"))
    parts = components(found.where("_edge").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    hashed = folded.select(F.xxhash64("_v").alias("_h"), "_v", "_rep", "_n")
    known = hashed.join(links, F.col("_rep") == F.col("_a"), "left").join(parts, F.col("_rep") == F.col("vertex"), "left")
    known = known.select("_h", "_v", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"), F.coalesce("component", "_rep").alias("_component"))
    out = usable.select("_id", F.xxhash64("_v").alias("_h"), "_v").join(known, ["_h", "_v"]).select("_id", "_links", "_component")
    alone = rows.where(~good).select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component"))
    out = out.unionByName(alone)
    return out.select(F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept"))


def _verified(table: pa.Table, lattice: Lattice, threshold: float) -> pa.Table:
    """Link counts (False, id, number) and spanning edges (True, id, id) of a batch of tasks."""
    cell = table.column("_cell").to_numpy().view(np.uint64)
    i, j = table.column("_i").to_numpy(), table.column("_j").to_numpy()
    order = np.lexsort((j, i, cell))
    table, cell, i, j = table.take(pa.array(order)), cell[order], i[order], j[order]
    rep, own, home, weight = (table.column(c).to_numpy() for c in ("_rep", "_own", "_home", "_n"))
    sizes = table.column("_v").combine_chunks().value_lengths().to_numpy()
    width = int(sizes.max())
    unit = np.zeros((len(cell), width))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        unit[rows, :size] = _units(table.column("_v").take(pa.array(rows)))
    starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    ids, vertex = np.unique(rep, return_inverse=True)
    links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
    codes, coded = np.empty((len(ids), lattice.tables, 1 + lattice.probes), np.uint64), np.zeros(len(ids), bool)

    def count(left: np.ndarray, right: np.ndarray) -> None:
        """Adds the links of near pairs of rows that count in their cell."""
        used, first = np.unique(vertex[np.r_[left, right]], return_index=True)
        fresh = np.r_[left, right][first[~coded[used]]]
        for size in np.unique(sizes[fresh]).tolist():
            rows = fresh[sizes[fresh] == size]
            codes[vertex[rows]] = lattice.cells(unit[rows, :size])
        coded[vertex[fresh]] = True
        for k in range(0, len(left), PAIRS):
            x, y = left[k : k + PAIRS], right[k : k + PAIRS]
            here = lattice.counted_in(codes[vertex[x]], codes[vertex[y]]) == cell[x]
            x, y = x[here], y[here]
            np.add.at(links, vertex[x], weight[y])
            np.add.at(links, vertex[y], weight[x])
            x, y = vertex[x], vertex[y]
            while (apart := parent[x] != parent[y]).any():  # every vertex points at its root
                x, y = x[apart], y[apart]
                np.minimum.at(parent, np.maximum(parent[x], parent[y]), np.minimum(parent[x], parent[y]))
                while (parent != (up := parent[parent])).any():
                    parent[:] = up

    left, right, waiting = [], [], 0
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
        if b - a < 2 or not home[a:b].any():
            continue
        same = i[a] == j[a]
        if same:
            x = y = np.arange(a, b)
        else:
            x, y = a + np.flatnonzero(own[a:b] == i[a]), a + np.flatnonzero(own[a:b] == j[a])
        rows = max(1, PAIRS // max(1, len(y)))
        for k in range(0, len(x), rows):
            z = x[k : k + rows]
            near = (unit[z] @ unit[y].T >= threshold) & (home[z][:, None] | home[y][None]) & (sizes[z][:, None] == sizes[y][None]) & (rep[z][:, None] != rep[y][None])
            p, q = np.nonzero(near & (z[:, None] < y[None]) if same else near)
            left.append(z[p])
            right.append(y[q])
            waiting += len(p)
            if waiting >= PAIRS:
                count(np.concatenate(left), np.concatenate(right))
                left, right, waiting = [], [], 0
    if waiting:
        count(np.concatenate(left), np.concatenate(right))
    met = links > 0
    edges = np.flatnonzero(parent != np.arange(len(ids)))
    edges = np.stack([ids[edges], ids[parent[edges]]], 1).astype(np.int64)
    ids, links = ids[met], links[met]
    kind = np.r_[np.zeros(len(ids), bool), np.ones(len(edges), bool)]
    return pa.Table.from_arrays([pa.array(kind), pa.array(np.r_[ids.astype(np.int64), edges[:, 0]]), pa.array(np.r_[links, edges[:, 1]])], ["_edge", "_a", "_b"])
