"""Every registered query beside its SQL on the smallest data set."""

import math

import duckdb
import pytest

import catalog

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

catalog.load_all()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def comparable(rows):
    def value(x):
        return None if isinstance(x, float) and math.isnan(x) else x

    return sorted((tuple(value(x) for x in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        assert df.count() > 0
        return
    answer = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(answer.columns) == columns
    got = comparable(df.select(columns).collect())
    assert got == comparable(answer.select(*[f'"{c}"' for c in columns]).fetchall())
