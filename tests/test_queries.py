"""Every query of the reference's operators against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidecover.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def key(row):
    return tuple((x is None, str(type(x)) if x is None else "", 0 if x is None else x) for x in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    rel = duck.execute(ORACLE[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
