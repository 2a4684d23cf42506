"""Connected components of an edge table by alternating star contraction, in DataFrame functions.

Every round, each vertex's larger neighbours are hung on its smallest (large star), then each vertex's smaller
neighbours on its smallest (small star). Edges never grow in number, and a path shortens geometrically. Minima are
grouped with a map-side combine, and the join that hands them out is on a rewritten key, so adaptive execution can
split a vertex that a third of all edges share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import dropped, rekeyed, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "component", most_rounds: int = 60) -> DataFrame:
    """(vertex, label): each vertex of an edge and the smallest vertex that it reaches. Null ends and loops are left out.

    Repeated edges do not matter; no edges give no rows. Raises RuntimeError if ``most_rounds`` did not suffice, which
    takes a path of more than 2 to the power of most_rounds / 2 vertices.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        last, now = now, stored(_small_star(_large_star(now)), "stars")
        dropped(last)
    else:
        raise RuntimeError("components did not settle")
    # Every edge now leads from a vertex to its component.
    return now.select(F.col("u").alias("vertex"), F.col("v").alias(label)).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias(label)).distinct())


def _hung(pairs: DataFrame) -> DataFrame:
    """pairs (x, y): each y hung on the smallest of x's neighbours and x itself."""
    least = pairs.groupBy("x").agg(F.min("y").alias("m")).select(rekeyed("x").alias("k"), F.least("x", "m").alias("m"))
    return pairs.select(rekeyed("x").alias("k"), "x", "y").join(least, "k")


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    hung = _hung(pairs).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    return hung.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    pairs = edges.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
    hung = _hung(pairs)
    ends = hung.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(hung.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return ends.where("u != v").distinct()
