"""Every core query with an oracle against DuckDB on the smallest test data."""

from pathlib import Path

import duckdb
import pytest

from larkspur.queries import registry

DATA = Path("/root/testdata/sf0.001")


def cell(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return repr(v)


def multiset(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert multiset(df.columns, [tuple(r) for r in df.collect()]) == multiset(columns, want.fetchall())
