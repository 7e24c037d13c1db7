"""Each query of the engine against its SQL twin on the public tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from tessera import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = db.sql(queries.SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


def test_layout_metrics_runs_the_whole_schedule(spark):
    rows = queries.QUERIES["layout_metrics"](spark, "/root/testdata/sf0.001").orderBy("iter").collect()
    assert [r["iter"] for r in rows] == list(range(1, 101))
