"""Every query with SQL against DuckDB on the smallest tables; the others at least run and are deterministic."""

from __future__ import annotations

import datetime
import os
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {k: f for k, f in __spark_entry__.queries().items() if not re.match(r"op\d+_", k) and k != "pipeline"}
SQL = __spark_entry__.oracle_sql()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((repr(tuple(plain(r[i]) for i in at)) for r in found))


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, sf, duck, name):
    df = OWN[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in SQL:
        rel = duck.execute(SQL[name])
        columns = [d[0] for d in rel.description]
        want = rows(columns, rel.fetchall())
        assert sorted(df.columns) == sorted(columns)
        assert got == want
    else:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        try:
            again = OWN[name](spark, sf)
            assert rows(again.columns, again.collect()) == got
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_outside_imports_the_corpus_operators():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent
    for p in root.joinpath("shelfspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "shelfspark.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
