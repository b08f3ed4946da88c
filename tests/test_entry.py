import importlib

import duckdb
import pytest

import __spark_entry__
from tidemill import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, db, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name in registry.oracle_sql():
        want = db.sql(registry.oracle_sql()[name])
        assert shown(rows, df.columns) == shown(want.fetchall(), want.columns)
    else:
        assert rows


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert importlib.reload(__spark_entry__).queries().keys() >= registry.queries().keys()
