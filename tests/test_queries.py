"""Every query over the driver's smallest tables against its DuckDB twin."""

from __future__ import annotations

import os

import duckdb
import pytest

from lanewright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}/**" if os.path.isdir(f"{SF}/{name}") else f"{SF}/{name}"
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    found = registry.QUERIES[name](spark, SF)
    rows = found.collect()
    spark.catalog.clearCache()
    if name in registry.ORACLE_SQL:
        cursor = tables.execute(registry.ORACLE_SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(found.columns)
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(map(repr, cursor.fetchall()))
    else:
        assert rows
