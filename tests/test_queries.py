"""Every registered query of the core against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from corvane.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for p in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, tiny, name):
    df = QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in ORACLES:
        rel = con.execute(ORACLES[name])
        names = [x[0] for x in rel.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    else:
        assert rows


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
