"""Every registered query against the SQL that answers it, on whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as registered

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


SQL_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return [columns[i] for i in order], sorted(
        tuple(cell(row[i]) if row[i] is not None else "" for i in order) for row in rows
    )


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = registered.queries()[name](spark, SF_DIR)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(registered.oracle_sql()[name])
    expected = canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert dict(df.dtypes) == {d[0]: SQL_TYPES[str(d[1])] for d in cursor.description}
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]
    assert got[1], "the query is meant to find something"
