"""Every query with SQL agrees with it on the smallest tables."""

from __future__ import annotations

import decimal
import os

import pytest

from orrery.catalogue_of_queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_DATA", "/root/testdata") + "/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def normal(rows):
    """Rows in an order of their own, numbers to four places and NaN as null, whatever else a row holds."""
    plain = lambda v: None if v is None or v != v else round(float(v), 4) + 0.0 if isinstance(v, (float, decimal.Decimal)) else v
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    wanted = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert normal(rows) == normal([tuple(r[i] for i in order) for r in wanted.fetchall()])
