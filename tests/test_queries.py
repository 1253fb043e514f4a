"""Every query against its SQL, side by side on the smallest tables."""

import math

import duckdb
import pytest

from millrace.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return [plain(x) for x in value] if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, sql, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.oracle_sql():
        assert rows
        return
    found = sql.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}
    assert {c: kinds[t] for c, t in df.dtypes} == dict(zip(found.columns, map(str, found.types), strict=True))
