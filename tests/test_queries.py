"""Queries against their SQL over the smallest tables."""

import math

import duckdb
import pytest

from factloom.plans import queries as core

SF = "/root/testdata/sf0.001"
NAMES = ["search", "per_pattern_cap", "parse_patterns", "shape_summary", "graph_describe", "chunk_text", "bm25", "evaluate_run", "facts_from_records", "validate_rows", "char_stats", "qrels_load", "record", "bootstrap", "explain_hits", "pipeline_run", "run_counters", "backoff", "token_stats", "graph_roundtrip", "encoder_roles", "frames"]


def tidy(v):
    return round(float(v), 5) if isinstance(v, float) else None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings benchmark labels conversations events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = core.queries()[name](spark, SF)
    columns = sorted(ours.columns)
    want = con.sql(core.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = sorted((tuple(map(tidy, r)) for r in ours.select(columns).collect()), key=repr)
    assert rows == sorted((tuple(map(tidy, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
