"""Every query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from sheetmill.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def shown(rows, columns, order):
    at = [columns.index(c) for c in order]

    def cell(v):
        if v is None or v != v:
            return "null"
        return format(float(v), ".9g") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[k]) for k in at) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert shown(rows, df.columns, sorted(columns)) == shown(found.fetchall(), columns, sorted(columns))
    else:
        assert rows


def test_entry():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
