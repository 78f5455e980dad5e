"""Every registered query against its SQL, on the smallest data set."""

import os

import duckdb
import pytest

from stowage.plans.registry import ORACLES, QUERIES

DATA = os.environ.get("STOWAGE_TESTDATA", "/root/testdata/sf0.001")
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{file}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cursor = duck.execute(ORACLES[name])
    types = {c[0]: TYPES.get(str(c[1])) for c in cursor.description}
    assert sorted(types) == sorted(df.columns)
    assert all(t is None or dict(df.dtypes)[c] == t for c, t in types.items())
    assert canonical(rows, df.columns) == canonical(cursor.fetchall(), list(types))


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
