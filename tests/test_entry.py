import __spark_entry__ as entry


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns and found.limit(1).collect()


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
