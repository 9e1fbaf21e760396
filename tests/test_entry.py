import duckdb
import pytest

import __spark_entry__ as entry
from vicinal.plans import oracles, queries

SF = "/root/testdata/sf0.001"


def rows(df):
    columns = sorted(df.columns)

    def plain(x):
        return round(float(x), 6) + 0.0 if isinstance(x, float) else x.item() if hasattr(x, "item") else x

    return columns, sorted(tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "lineitem", "events", "part", "orders", "nation"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(c.sql(oracles.ORACLES[name]).df())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
