import __spark_entry__ as e


def test_entry(spark, sf):
    assert e.entry(spark).count() == 5


def test_names():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 55
