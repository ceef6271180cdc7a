import __spark_entry__ as entry


def test_entry_imports_and_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert "q_var_hist" in q and set(o) <= set(q)


def test_flagship(spark):
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 20
