"""Every registered query against its SQL in another engine, on the smallest tables."""

import math

import duckdb
import pytest

from skylattice.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return float(value) if type(value).__name__ == "Decimal" else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def other(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, other, name):
    df = catalogue.QUERIES[name](spark, sf)
    found = df.collect()
    assert found
    if name in catalogue.ORACLE:
        r = other.execute(catalogue.ORACLE[name])
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, found) == rows(columns, r.fetchall())
