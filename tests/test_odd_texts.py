"""Queries against their SQL over texts that the tables rarely hold."""

import duckdb
import pytest

from factloom.plans import queries as core

TEXTS = ["", "  ", "\t\n ", None, '"', "\\", 'say "hi" c:\\path', 'a"b', "tab\x01x y\x02z", "x" + " " * 50, " " * 50 + "x y" + "\n" * 30, "plain words here", 'token="abc"']


@pytest.mark.parametrize("name", ["pipeline_run", "run_counters"])
def test_same_as_sql_on_odd_texts(spark, tmp_path, name):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(12 * len(TEXTS))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    ours = core.queries()[name](spark, str(tmp_path))
    want = con.sql(core.oracle_sql()[name]).select(*[f'"{c}"' for c in ours.columns]).fetchall()
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(want, key=repr)
