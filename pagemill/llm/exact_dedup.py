"""Exact dedup: one row of each group of byte-identical texts stays.

Rows meet under a 128-bit content hash; inside a hash the texts themselves are grouping keys, so a collision of
hashes splits into as many groups as it has texts. Everything is DataFrame functions.

Scale. Texts are grouped with a map-side combine, so a group of copies that holds a third of all rows sends one row
per map task. What comes back to the rows is joined on the hash as two halves: the grouping's own partitioning does
not serve that join, both sides of which are therefore exchanged, and adaptive execution can split a hot hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored, text_column


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    keep: ``smallest`` or ``largest`` id of a group stays. A null text counts as empty, and empty texts form a group
    like any other. Null ids lose against any id; a group with null ids only has a null keep_id and keeps all its
    rows. Rows that repeat an id within a group are kept or dropped together. An empty table gives an empty result.
    Other columns, whatever their names, are not read.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), text_column(text_col).alias("_text")).withColumn("_h", F.md5("_text"))
    groups = rows.groupBy("_h", "_text").agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    by_hash = stored(groups.groupBy("_h").agg(F.max("_keep").alias("_keep"), F.max("_size").alias("_size"), F.count(F.lit(1)).alias("_texts")), "exact-groups")
    halves = [F.substring("_h", 1, 16).alias("_h1"), F.substring("_h", 17, 16).alias("_h2")]
    sha = F.sha2("_text", 256).alias("text_sha256")
    found = rows.select("_id", sha, *halves).join(by_hash.where("_texts = 1").select("_keep", "_size", *halves), ["_h1", "_h2"])
    if by_hash.where("_texts > 1").limit(1).count():  # texts that differ under one hash: compare them byte by byte
        clash = by_hash.where("_texts > 1").select("_h")
        exact = rows.join(clash, "_h", "left_semi").join(groups.join(clash, "_h", "left_semi"), ["_h", "_text"])
        found = found.select("_id", "_keep", "_size", "text_sha256").unionByName(exact.select("_id", "_keep", "_size", sha))
    return found.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), "text_sha256")


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns in their order: of each group of equal texts the one with the ``keep`` id.

    Null texts equal empty ones. Null ids lose; rows that tie in the id are told apart by a hash of their other
    columns, and of rows equal in everything one stays. One shuffle: the text is the grouping key and comes back as it.
    """
    best = {"smallest": F.min_by, "largest": F.max_by}[keep]
    others = [c for c in docs.columns if c != text_col]
    known = F.col(f"`{id_col}`").isNull() if keep == "smallest" else F.col(f"`{id_col}`").isNotNull()
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").isNull().alias("_no_text"))
    rank = F.struct(known.alias("a"), F.col(f"`{id_col}`").alias("b"), F.xxhash64(rest).alias("c"))
    rows = docs.select(rest.alias("_rest"), rank.alias("_rank"), text_column(f"`{text_col}`").alias("_text")).withColumn("_h", F.md5("_text"))
    kept = rows.groupBy("_h", "_text").agg(best("_rest", "_rank").alias("_rest"))
    text = F.when(~F.col("_rest")["_no_text"], F.col("_text")).cast(docs.schema[text_col].dataType).alias(text_col)
    return kept.select(*[text if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns])
