"""The driver contract, and each query against its oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from helixframe.plans import catalogue

HERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{HERE}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, HERE)
    cols = sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(catalogue.ORACLES[name])
    names = [x[0] for x in rel.description]
    want = sorted((tuple(tidy(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted(names) == cols and got == want
