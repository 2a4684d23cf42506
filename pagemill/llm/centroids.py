"""Centroid clustering of vectors in exact integers, with an exponion search.

Each vector carries its centroid, an upper bound of the distance to it and a lower bound of that to any other. After the
centroids have moved, bounds are loosened by how far they moved; a vector whose upper bound is below the lower one, or
below half the distance from its centroid to the next, needs no look at all. The others measure the distance to their own
centroid, and then only to the centroids inside a ball around it: at a distance of u from its own centroid, which is
s from its nearest neighbour, no centroid further than 2 u + s from it can be as near as that neighbour. Each centroid's list of
neighbours, sorted by distance, ends where the ball does; its rim belongs to it, so that ties are found.

Components are integers, floor(scale * x), so distances, sums and means are exact; bounds are square roots moved outwards.

Scale. A round is one pass over the vectors, without a shuffle of them: a task returns the sums of its clusters, k times the
number of components, and these are added up. The centroids, k of them, go through the driver, whatever the number of vectors. Each
round's table replaces the last one, so a lost executor costs one round's reading at most.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pagemill.llm.common import dropped, stored

#: Moves bounds outwards by more than a square root can be off.
OUT, IN = 1 + 1e-12, 1 - 1e-12
LONG = (1 << 63) - 1


def narrow_below(size: int) -> int:
    """What components must be smaller than for doubles to hold squared distances of ``size`` of them exactly."""
    return 1 << max(0, (52 - math.ceil(math.log2(max(size, 1)))) // 2 - 1)


def floored(x: list[float], scale: int) -> list[int]:
    """floor(scale * x), exact whatever the size."""
    return [math.floor(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in x]


class Centroids:
    """Centroids with what the search needs: their distances, and of each its neighbours by distance."""

    def __init__(self, at: list[list[int]], before: Centroids | None = None):
        self.at = at
        exact = np.array(at, object)
        gaps = ((exact[:, None] - exact[None]) ** 2).sum(2)
        self.apart = np.sqrt(gaps.astype(np.float64)) * OUT
        #: Of each centroid all, itself first, nearest first; and how far they are at least.
        self.order = np.argsort(self.apart - np.eye(len(at)), axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.apart, self.order, 1) * IN**2
        self.next = self.sorted[:, 1] if len(at) > 1 else np.full(len(at), np.inf)
        self.narrow = max((abs(x) for c in at for x in c), default=0) < narrow_below(len(at[0]))
        self.values = np.array(at, np.float64) if self.narrow else None
        moved = ((exact - np.array(before.at, object)) ** 2).sum(1) if before else np.zeros(len(at))
        self.moved = np.sqrt(moved.astype(np.float64)) * OUT


def wide_nearest(vectors: list[list[int]], centroids: Centroids) -> list[tuple[int, int, int]]:
    """(nearest, its squared distance, the next one's) with Python's integers."""
    out = []
    for v in vectors:
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids.at]
        near = min(range(len(d)), key=lambda i: (d[i], i))
        out.append((near, d[near], min((x for i, x in enumerate(d) if i != near), default=-1)))
    return out


def searched(x: np.ndarray, own: np.ndarray, up: np.ndarray, low: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid, the bounds of its distances, and how many distances were measured.

    own, up, low: what holds for these centroids, own -1 where nothing is known.
    """
    own, up, low, measured = own.copy(), up.copy(), low.copy(), 0
    fresh = own < 0
    own[fresh], up[fresh], low[fresh] = 0, np.inf, 0.0
    look = np.flatnonzero(up >= np.maximum(low, c.next[own] / 2))
    exact = ((x[look] - c.values[own[look]]) ** 2).sum(1)
    measured += len(look)
    up[look] = np.sqrt(exact) * OUT
    still = up[look] >= np.maximum(low[look], c.next[own[look]] / 2)
    look, exact = look[still], exact[still]
    start = own[look]
    for a in np.unique(start).tolist():
        rows = np.flatnonzero(start == a)
        ball = 2 * up[look[rows]] + c.apart[a, c.order[a, 1]] if len(c.at) > 1 else np.zeros(len(rows))
        reach = np.searchsorted(c.sorted[a], ball, side="right")
        best, second, at = exact[rows].copy(), np.full(len(rows), np.inf), np.full(len(rows), a)
        for j in range(1, int(reach.max(initial=0))):
            b = int(c.order[a, j])
            inside = np.flatnonzero(reach > j)
            d = ((x[look[rows[inside]]] - c.values[b]) ** 2).sum(1)
            measured += len(inside)
            wins = (d < best[inside]) | ((d == best[inside]) & (b < at[inside]))
            second[inside] = np.minimum(second[inside], np.where(wins, best[inside], d))
            best[inside], at[inside] = np.where(wins, d, best[inside]), np.where(wins, b, at[inside])
        own[look[rows]], up[look[rows]] = at, np.sqrt(best) * OUT
        # What lies outside the ball is at least as far as the nearest neighbour's bound, which is inside.
        low[look[rows]] = np.sqrt(second) * IN if len(c.at) > 1 else np.inf
    return own, up, low, measured


def _exact(vectors: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Components as exact doubles where they are narrow, and which rows are not."""
    with np.errstate(over="ignore"):
        x = np.floor(vectors * scale)
    return x, ~(np.abs(x) < narrow_below(x.shape[1])).all(1)


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _stepped(table: DataFrame, centroids: Centroids, scale: int, size: int, schema: str) -> DataFrame:
    """The vectors with their centroids and bounds for ``centroids``, from those for the ones before."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, wide = _exact(_matrix(batch.column(1), size), scale)
            own, up, low = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 4))
            known = own >= 0
            up[known] = (up[known] + centroids.moved[own[known]]) * OUT
            low[known] = (low[known] - centroids.moved.max()) * IN - 1e-300
            rows = np.flatnonzero(~wide) if centroids.narrow else np.zeros(0, np.int64)
            if len(rows):
                own[rows], up[rows], low[rows], _ = searched(x[rows], own[rows], up[rows], np.maximum(low[rows], 0), centroids)
            rest = np.setdiff1d(np.arange(len(x)), rows)
            exact = batch.column(1).take(pa.array(rest)).to_pylist()
            for i, (near, *_) in zip(rest.tolist(), wide_nearest([floored(v, scale) for v in exact], centroids), strict=True):
                own[i], up[i], low[i] = near, np.inf, 0.0
            yield pa.record_batch([batch.column(0), batch.column(1), own, up, low], names=batch.schema.names)

    return table.mapInArrow(step, schema)


def _added_up(table: DataFrame, scale: int, size: int) -> list[Row]:
    """(cluster, component, sum, count): each task's sums, then those of all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, wide = _exact(_matrix(batch.column(0), size), scale)
            own = batch.column(1).to_numpy()
            for a in np.unique(own).tolist():
                rows = np.flatnonzero((own == a) & ~wide)
                parts = [[int(s) for s in x[rows].astype(np.int64).sum(0)]]
                parts += [floored(v, scale) for v in batch.column(0).take(pa.array(np.flatnonzero((own == a) & wide))).to_pylist()]
                sums[a] = [sum(p) for p in zip(sums.get(a, [0] * size), *parts, strict=True)]
                counts[a] = counts.get(a, 0) + int((own == a).sum())
        rows = [(a, i, s, counts[a]) for a, total in sums.items() for i, s in enumerate(total)]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array([str(s) for s in columns[2]], pa.string()), pa.array(columns[3], pa.int64())], names=["_cluster", "_at", "_sum", "_n"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_cluster": pdf["_cluster"][:1], "_at": pdf["_at"][:1], "_sum": [str(sum(map(int, pdf["_sum"])))], "_n": [pdf["_n"].sum()]})

    schema = "_cluster int, _at int, _sum string, _n long"
    told = table.select("_v", "_own").mapInArrow(add, schema)
    return told.groupBy("_cluster", "_at").applyInPandas(total, schema).collect()


def _measured(table: DataFrame, centroids: Centroids, scale: int, size: int) -> DataFrame:
    """(_id, _own, _distance): exact squared distances, null where they pass 64 bits."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, wide = _exact(_matrix(batch.column(1), size), scale)
            own = batch.column(2).to_numpy()
            rest = np.flatnonzero(wide) if centroids.narrow else np.arange(len(x))
            far = np.zeros(len(x), object)
            if centroids.narrow:
                far[~wide] = ((x[~wide] - centroids.values[own[~wide]]) ** 2).sum(1).astype(np.int64)
            for i, v in zip(rest.tolist(), batch.column(1).take(pa.array(rest)).to_pylist(), strict=True):
                far[i] = sum((a - b) ** 2 for a, b in zip(floored(v, scale), centroids.at[own[i]], strict=True))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([int(d) if d <= LONG else None for d in far], pa.int64())], names=["_id", "_own", "_distance"])

    return table.select("_id", "_v", "_own").mapInArrow(measure, f"_id {table.schema['_id'].dataType.simpleString()}, _own int, _distance long")


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector of ``size`` components: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Components count as floor(scale * x). Centroids start as the k vectors with the smallest sha256 of ``seed:id``, numbered in
    that order. Each round takes every vector to the nearest centroid, of several the smaller number, and moves the centroids
    to the floors of their vectors' means; one without vectors stays. Then vectors are taken once more. distance is squared;
    cluster_inertia and inertia are its sums; centroid_sha256 is that of the final components as decimals joined by commas.

    Vectors that are null, of another size, or hold a null or a component that isn't finite are left out; an empty table gives an
    empty result. Fewer than k vectors are centroids all. Repeated rows are vectors of their own, null ids hash last, and rows
    that share an id come in the order of their components. A distance or sum beyond 64 bits is null. Other columns are not read.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(f"`{vector_col}`") if element in ("float", "double") else F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), v.alias("_v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = rows.where((F.size("_v") == size) & ~F.exists("_v", odd))
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256).asc_nulls_last(), "_v").limit(k).collect()
    own_id = vectors.schema[id_col].dataType.simpleString()
    if not first:
        return kept.select(F.col("_id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centroids = Centroids([floored(r["_v"], scale) for r in first])
    schema = f"_id {own_id}, _v {kept.schema['_v'].dataType.simpleString()}, _own int, _up double, _low double"
    at = kept.select("_id", "_v", F.lit(-1).alias("_own"), F.lit(0.0).alias("_up"), F.lit(0.0).alias("_low"))
    for i in range(rounds + 1):
        before, at = at, stored(_stepped(at, centroids, scale, size, schema), "centroid-round")
        if i:
            dropped(before)
        if i < rounds:
            moved = [list(c) for c in centroids.at]
            for r in _added_up(at, scale, size):
                moved[r["_cluster"]][r["_at"]] = int(r["_sum"]) // r["_n"]
            centroids = Centroids(moved, centroids)
    measured = _measured(at, centroids, scale, size)
    whole = lambda c: F.when(F.count(F.lit(1)) == F.count(c), F.sum(F.col(c).cast("decimal(38, 0)")))
    sums = {r["_own"]: r["_sum"] for r in measured.groupBy("_own").agg(whole("_distance").alias("_sum")).collect()}
    fits = lambda x: int(x) if x is not None and x <= LONG else None
    inertia = fits(sum(sums.values())) if None not in sums.values() else None
    told = [(c, fits(n), hashlib.sha256(",".join(map(str, centroids.at[c])).encode()).hexdigest()) for c, n in sums.items()]
    told = vectors.sparkSession.createDataFrame(told, "_own int, cluster_inertia long, centroid_sha256 string")
    found = measured.join(F.broadcast(told), "_own")  # k rows at most
    return found.select(F.col("_id").alias(id_col), F.col("_own").alias("cluster"), F.col("_distance").alias("distance"), "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")
