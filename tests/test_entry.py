import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "risk_score" in df.columns


def test_every_oracle_has_a_query():
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 100
    for name in ("mart_user_risk_score", "window_features", "ledger_running_balance"):
        assert name in os_
