import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).columns == ["k", "parts", "n", "none"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
