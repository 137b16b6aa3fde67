"""Every query with SQL gives what an independent engine gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from cubelark.plans.cleaning import CLEANING
from cubelark.plans.cleaning_sql import CLEANING_SQL
from cubelark.plans.files import FILES, FILES_SQL
from cubelark.plans.oracles import ORACLES
from cubelark.plans.queries import QUERIES
from cubelark.plans.rows_only import ROWS_ONLY

ALL, SQL = QUERIES | CLEANING | FILES, ORACLES | CLEANING_SQL | FILES_SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def bag(rows, order):
    def form(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return None.__str__() if isinstance(v, float) and math.isnan(v) else f"{float(v):.6f}"

    return sorted(tuple(form(r[i]) for i in order) for r in rows)


def test_catalogues_match():
    assert set(QUERIES) == set(ORACLES) and set(CLEANING) == set(CLEANING_SQL) and set(FILES) == set(FILES_SQL)
    assert len(ALL) == len(QUERIES) + len(CLEANING) + len(FILES) and not set(ALL) & set(ROWS_ONLY)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sql, name):
    df, ref = ALL[name](spark, DATA), sql.sql(SQL[name])
    assert sorted(df.columns) == sorted(ref.columns)
    names = sorted(df.columns)
    assert bag(df.collect(), [df.columns.index(n) for n in names]) == bag(ref.fetchall(), [ref.columns.index(n) for n in names])
