import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"query_id", "rank", "doc_id", "title", "score"}
    assert len(rows) > 0


def test_oracle_keys_are_registered():
    q, s = E.queries(), E.oracle_sql()
    from wordmill.plans.registry import QUERIES
    assert {k for k in s if k in QUERIES} == set(QUERIES)
    assert set(s) <= set(q)
