"""The entry points."""

import __spark_entry__


def test_names_agree():
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and len(known) >= 60


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
