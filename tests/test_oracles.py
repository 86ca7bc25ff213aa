"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from evalframe.plans.oracles import oracle_sql
from evalframe.plans.queries import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = oracle_sql()


def value(x):
    if x is None:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return "~" if x != x else float(x) + 0.0
    return str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    columns, expected = [c[0] for c in want.description], want.fetchall()
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, df.collect())
    assert got == rows(columns, expected)
    assert got


def test_all_queries_but_those_without_sql_have_an_oracle():
    assert set(queries()) - set(ORACLES) == {"gen_dataset", "mock_run_profile"}


def test_messages_of_null_and_empty_texts(spark, tmp_path):
    docs = [(1, "a\nb"), (2, "a\nb"), (3, None), (4, None), (5, ""), (6, ""), (None, "x"), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLES["build_messages"])
    columns, expected = [c[0] for c in want.description], want.fetchall()
    df = queries()["build_messages"](spark, str(tmp_path))
    got = rows(df.columns, df.collect())
    assert got == rows(columns, expected) and len(got) == len(docs)
