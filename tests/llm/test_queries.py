"""The registered queries: SQL against DuckDB where there is any, and the columns that the contract names."""

from pathlib import Path

import duckdb
import pytest

from pagemill.llm import registry

COLUMNS = {
    "op1": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op2": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op3": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op4": {"vec_id", "n_links", "component_id", "kept"},
    "op5": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6": {"doc_id", "held_out", "lang_pred", "score"},
    "op7": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op8": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op9": {"doc_id", "n_shingles", "component_id"},
    "op10": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op11": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
    "op12": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    "op13": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_duckdb(spark, tiny, name):
    c = duckdb.connect()
    for f in Path(tiny).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    got, want = registry.QUERIES[name](spark, tiny).toPandas(), c.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(tuple, got[cols].astype(str).values.tolist())) == sorted(map(tuple, want[cols].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_columns(spark, tiny, name):
    df = registry.QUERIES[name](spark, tiny)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    assert df.count() >= (100 if name.startswith("op11") else 200)
