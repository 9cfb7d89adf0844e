"""Every catalogue query against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quern import queries


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in queries.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(data) / t}.parquet')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(f"{v:.9g}")
    return str(v)


def rows(table):
    return sorted((tuple(plain(r[k]) for k in sorted(table.column_names)) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_duckdb(spark, data, duck, name):
    found = queries.QUERIES[name](spark, data).toArrow()
    if name not in queries.ORACLE_SQL:
        assert found.num_rows
        return
    wanted = duck.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(wanted.column_names)
    assert rows(found) == rows(wanted)
