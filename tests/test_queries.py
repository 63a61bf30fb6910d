"""Every query of the engine that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from docengine.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns: list[str], found: list) -> list:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(r[i] for i in at)) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    got, want = registry.QUERIES[name](spark, sf_dir), con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    found = [tuple(r) for r in got.collect()]
    assert rows(got.columns, found) == rows(want.columns, want.fetchall())
    assert found


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
