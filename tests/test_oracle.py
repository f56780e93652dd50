"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from pulseloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        return None if isinstance(v, float) and v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None or isinstance(v, (str, bool)) else str(v)

    return sorted((repr([value(v) for v in r]) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())
