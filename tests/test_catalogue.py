"""Every query against its SQL, over whole tables of the smallest scale."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from copse.catalogue import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return Counter(repr(tuple(tuple(x) if isinstance(x, list) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    want = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({ORACLES[name]})").fetchall()
    assert plain(map(tuple, df.select(*cols).collect())) == plain(want)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
