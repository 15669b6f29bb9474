"""Every query of the core catalogue against its SQL, at the smallest size."""

import duckdb
import pytest

from marlstone.plans.catalogue import ORACLE, QUERIES
from marlstone.sources.tables import NAMES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(cols).collect())
    if name not in ORACLE:
        return
    r = con.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
