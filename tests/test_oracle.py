"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from check_oracle import TABLES, rows
from tagloom.queries import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows((df.columns, [tuple(r) for r in df.collect()]))
    assert got[1] or name in ("j3_pending",)
    if name in SQL:
        cur = db.execute(SQL[name])
        assert got == rows(([d[0] for d in cur.description], cur.fetchall()))


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"m1_fit_head", "i2_phash", "i3_augment"}
