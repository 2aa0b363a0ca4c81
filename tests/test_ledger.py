from datetime import datetime, timedelta

from txnlake.operators import ledger as L
from txnlake.plans.base import fact_df

from .conftest import SF001


def _sequential(rows, b0):
    bal, out = {}, {}
    for seq, t, typ, amt, src, dst in sorted(rows, key=lambda r: (r[1], r[0])):
        for leg, acct in ((0, src), (1, dst)):
            if leg == 0:
                d = amt if typ == "CASH_IN" else -amt
            else:
                d = amt if typ in ("CASH_IN", "TRANSFER") else (-amt if typ == "CASH_OUT" else 0.0)
            bal[acct] = max(0.0, bal.get(acct, b0) + d)
            out[(acct, seq, leg)] = bal[acct]
    return out


def test_ledger_floor_self_transfer_and_cash_out_to_customer(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(0, t0, "PAYMENT", 700.0, "C1", "M1"),
            (1, t0 + timedelta(hours=1), "TRANSFER", 900.0, "C1", "C2"),   # floors at 0
            (2, t0 + timedelta(days=3), "CASH_IN", 50.0, "C1", "C1"),      # self, later day
            (3, t0 + timedelta(days=3, hours=2), "CASH_OUT", 5000.0, "C3", "C2"),
            (4, t0 + timedelta(days=5), "DEBIT", 10.0, "C2", "M1")]
    df = spark.createDataFrame(rows, "txn_seq long, transaction_time timestamp, type string, "
                                     "amount double, user_id string, merchant_id string")
    exp = _sequential(rows, 1000.0)
    for limit in (0, 3, 1000):
        got = {(r.account, r.seq, r.leg): r.balance
               for r in L.ledger_running_balance(df, 1000.0, max_account_legs=limit).collect()}
        assert got.keys() == exp.keys()
        for k in exp:
            assert abs(got[k] - exp[k]) < 1e-9, (limit, k)


def test_ledger_bucketed_equals_sequential_on_data(spark):
    fact = fact_df(spark, SF001).select("txn_seq", "transaction_time", "type", "amount",
                                        "user_id", "merchant_id")
    rows = [tuple(r) for r in fact.collect()]
    exp = _sequential(rows, 1000.0)
    for width in (60, 86400):
        got = {(r.account, r.seq, r.leg): r.balance for r in L.ledger_running_balance(
            fact, 1000.0, max_account_legs=50, bucket_seconds=width).collect()}
        assert len(got) == len(exp)
        assert max(abs(got[k] - exp[k]) for k in exp) < 1e-6
    direct = {(r.account, r.seq, r.leg): r.balance
              for r in L.ledger_running_balance(fact, 1000.0).collect()}
    assert max(abs(direct[k] - exp[k]) for k in exp) < 1e-6


def test_dense_legs_without_times_amounts_and_accounts_in_every_split(spark):
    rows = [(i, None if i % 11 == 0 else datetime(2024, 1, 1) + timedelta(seconds=i * 7919 % 600),
             ("PAYMENT", "TRANSFER", "CASH_IN", "CASH_OUT")[i % 4],
             None if i % 7 == 0 else i * 0.37, None if i % 19 == 0 else f"C{i % 4}", f"C{i % 3}")
            for i in range(1200)]
    df = spark.createDataFrame(rows, "txn_seq long, transaction_time timestamp, type string, "
                                     "amount double, user_id string, merchant_id string")
    first = datetime(1970, 1, 1)
    exp = _sequential([(s, t or first, ty, a or 0.0, u, m) for s, t, ty, a, u, m in rows], 1000.0)
    runs = [{(r.account, r.seq, r.leg): r.balance for r in
             L.ledger_running_balance(df, max_account_legs=limit).collect()}
            for limit in (0, 500, 1 << 40)]
    assert runs[0] == runs[1] == runs[2] and runs[0].keys() == exp.keys()
    assert max(abs(runs[0][k] - exp[k]) for k in exp) < 1e-6


def test_repeated_rows_without_a_sequence_are_booked_one_by_one(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "TRANSFER", 800.0, "C1", "C1")] * 2,
                               "transaction_time timestamp, type string, amount double, "
                               "user_id string, merchant_id string")
    got = sorted(r.balance for r in L.ledger_running_balance(df).collect())
    assert got == [200.0, 200.0, 1000.0, 1000.0]  # debit, credit, debit, credit
