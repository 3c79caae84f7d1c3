import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    found, sql = entry.queries(), entry.oracle_sql()
    assert len(found) > 40 and set(sql) <= set(found)


def test_every_core_query_runs_on_the_smallest_tables(spark, sf):
    from foliomill.queries import QUERIES

    for name, query in QUERIES.items():
        df = query(spark, sf)
        assert len(df.columns) == len(set(df.columns)), name
        df.count()
