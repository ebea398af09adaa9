import os

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(__spark_entry__.core_queries.ORACLES)


@pytest.fixture(scope="module")
def db(tiny):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return con


def tidy(rows, names):
    def cell(x):
        return "None" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, tiny, name):
    df = __spark_entry__.queries()[name](spark, tiny)
    found = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert tidy([tuple(r) for r in df.collect()], df.columns) == tidy(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.core_queries.QUERIES) - set(NAMES)))
def test_queries_without_sql_run(spark, tiny, name):
    assert __spark_entry__.queries()[name](spark, tiny).count() > 0


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and os.path.exists(__spark_entry__.__file__)
