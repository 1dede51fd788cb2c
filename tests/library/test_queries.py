import math

import duckdb
import pytest

from lectern import queries, queries_more, queries_reports  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return found


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, db, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    rows, columns = frame.collect(), sorted(frame.columns)
    assert columns
    if name in queries.ORACLES:
        result = db.sql(queries.ORACLES[name])
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        expected = sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == expected


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
