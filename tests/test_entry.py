import __spark_entry__ as entry


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) >= 70


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
