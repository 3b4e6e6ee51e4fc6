import __spark_entry__ as entry_module


def test_registry_and_entry(spark):
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    assert {f"p{n}_found" for n in (3, 4, 5, 6, 7)} <= set(queries)
    assert entry_module.entry(spark).count() == 10
