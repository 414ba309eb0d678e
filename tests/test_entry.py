import __spark_entry__ as entry_mod


def test_entry_runs_with_stable_schema(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["doc_id", "split", "code", "y", "x"]
    assert df.count() == 200


def test_registry_needs_no_session():
    assert len(entry_mod.queries()) >= 80
    sql = entry_mod.oracle_sql()
    assert set(sql) <= set(entry_mod.queries())
