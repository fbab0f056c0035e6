import pytest
from compare import rows_of

from tidemark.plans import book, ingest, market, readings, records

PLANS = {**market.QUERIES, **book.QUERIES, **readings.QUERIES, **records.QUERIES, **ingest.QUERIES}
SQL = {**market.SQL, **book.SQL, **readings.SQL, **records.SQL, **ingest.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df, expected = PLANS[name](spark, sf), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = PLANS[name](spark, sf)
    rows = df.collect()
    assert rows and len(df.columns) > 1 and all(len(r) == len(df.columns) for r in rows)


def test_entry_contract(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and set(PLANS) <= set(e.queries())
