"""Every core query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from palimpsest.plans.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(FOLDER):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{FOLDER}/{t}'")
    return c


def flat(rows):
    return sorted(tuple(str(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLE[name]})").fetchall()
    assert flat(tuple(r) for r in df.select(*cols).collect()) == flat(want)
