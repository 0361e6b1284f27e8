import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    got = entry.entry(spark).collect()
    assert len(got) == 20 and got[0]["rank"] >= got[-1]["rank"]
