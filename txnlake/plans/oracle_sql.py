"""DuckDB SQL for the independent oracle.  The same events -> transaction mapping,
written once as CTEs, then each registered query's SQL on top.

Every DOUBLE output is rounded at 6 decimals through DECIMAL(38,12) on both sides
(Spark side: ``registry.stable``), so summation order cannot flip a value hash.
"""

from __future__ import annotations

EV = """ev AS (
  SELECT event_id AS eid, ts AS transaction_time,
    CASE event_type WHEN 'purchase' THEN 'PAYMENT' WHEN 'view' THEN 'CASH_OUT'
      WHEN 'signup' THEN 'CASH_IN' WHEN 'click' THEN 'TRANSFER' WHEN 'error' THEN 'DEBIT' END AS type,
    floor(value * 1000.0 * 100.0 + 0.5) / 100.0 AS amount,
    'C' || CAST(user_id AS VARCHAR) AS nameOrig,
    user_id AS user_num,
    epoch_us(ts) // 1000000 AS ts_seconds
  FROM events
), ev2 AS (
  SELECT *,
    CASE WHEN eid % 10 = 0 THEN 0.0 WHEN eid % 10 = 1 THEN amount
         ELSE amount + CAST(eid % 97 AS DOUBLE) * 100.0 END AS oldbalanceOrg,
    CASE WHEN eid % 3 = 0 THEN 0.0 ELSE CAST(eid % 53 AS DOUBLE) * 250.0 END AS oldbalanceDest
  FROM ev
)"""

LANDING = """landing AS (
  SELECT CAST(floor((ts_seconds - 1704067200) / 3600) + 1 AS INTEGER) AS step,
    type, amount, nameOrig, oldbalanceOrg,
    CASE WHEN eid % 4 = 0 THEN oldbalanceOrg ELSE greatest(oldbalanceOrg - amount, 0.0) END AS newbalanceOrig,
    CASE WHEN type IN ('PAYMENT', 'DEBIT') THEN 'M' || CAST(user_num // 150 * 20 + eid % 20 AS VARCHAR)
         ELSE 'C' || CAST(user_num // 150 * 150 + (eid * 7 + 3) % 150 AS VARCHAR) END AS nameDest,
    oldbalanceDest,
    CASE WHEN eid % 5 = 0 THEN oldbalanceDest ELSE oldbalanceDest + amount END AS newbalanceDest,
    CAST(CASE WHEN type IN ('TRANSFER', 'CASH_OUT') AND eid % 37 = 0 THEN 1 ELSE 0 END AS TINYINT) AS isFraud,
    CAST(CASE WHEN type = 'TRANSFER' AND amount > 200000 THEN 1 ELSE 0 END AS TINYINT) AS isFlaggedFraud,
    transaction_time,
    strftime(transaction_time, '%Y%m%d') AS part_dt,
    strftime(transaction_time, '%H') AS part_hour,
    eid AS txn_seq
  FROM ev2
)"""

SILVER = """silver AS (
  SELECT transaction_time, trim(type) AS type, amount, nameOrig AS user_id,
    oldbalanceOrg, newbalanceOrig, nameDest AS merchant_id, oldbalanceDest, newbalanceDest,
    isFraud, isFlaggedFraud,
    (oldbalanceOrg - amount) - newbalanceOrig AS errorBalanceOrig,
    (oldbalanceDest + amount) - newbalanceDest AS errorBalanceDest,
    CAST(CASE WHEN (oldbalanceOrg - amount) - newbalanceOrig != 0 THEN 1 ELSE 0 END AS TINYINT) AS is_errorBalanceOrig,
    CAST(CASE WHEN (oldbalanceDest + amount) - newbalanceDest != 0 THEN 1 ELSE 0 END AS TINYINT) AS is_errorBalanceDest,
    CAST(CASE WHEN trim(type) = 'TRANSFER' THEN 1 ELSE 0 END AS TINYINT) AS is_transfer,
    CAST(CASE WHEN trim(type) = 'CASH_OUT' THEN 1 ELSE 0 END AS TINYINT) AS is_cash_out,
    CAST(CASE WHEN starts_with(nameDest, 'M') THEN 1 ELSE 0 END AS TINYINT) AS is_merchant_dest,
    CAST(hour(transaction_time) AS TINYINT) AS hour_of_day,
    CAST(dayofweek(transaction_time) + 1 AS TINYINT) AS day_of_week,
    CAST(CASE WHEN amount = oldbalanceOrg THEN 1 ELSE 0 END AS TINYINT) AS is_all_orig_balance,
    CAST(CASE WHEN oldbalanceDest = 0 THEN 1 ELSE 0 END AS TINYINT) AS is_dest_zero_init,
    CAST(CASE WHEN oldbalanceOrg = 0 THEN 1 ELSE 0 END AS TINYINT) AS is_org_zero_init,
    part_dt, part_hour, txn_seq
  FROM landing
)"""

STG = """stg AS (
  SELECT transaction_time, type, amount, user_id, merchant_id,
    oldbalanceOrg AS old_balance_orig, newbalanceOrig AS new_balance_orig,
    oldbalanceDest AS old_balance_dest, newbalanceDest AS new_balance_dest,
    isFraud AS is_fraud, isFlaggedFraud AS is_flagged_fraud,
    errorBalanceOrig AS error_balance_orig, errorBalanceDest AS error_balance_dest,
    is_transfer, is_cash_out, is_merchant_dest, hour_of_day, day_of_week,
    is_all_orig_balance, is_dest_zero_init, is_org_zero_init,
    is_errorBalanceOrig AS is_error_balance_orig, is_errorBalanceDest AS is_error_balance_dest,
    part_dt, part_hour,
    user_id || '-' || CAST(epoch_us(transaction_time) // 1000000 AS VARCHAR) AS txn_id,
    txn_seq
  FROM silver
), fact AS (
  SELECT txn_id, transaction_time, type, amount, user_id, merchant_id,
    old_balance_orig, new_balance_orig, old_balance_dest, new_balance_dest,
    error_balance_orig, error_balance_dest, is_fraud, is_flagged_fraud,
    is_transfer, is_cash_out, is_merchant_dest, hour_of_day, day_of_week,
    is_all_orig_balance, is_dest_zero_init, is_org_zero_init,
    is_error_balance_orig, is_error_balance_dest, part_dt, part_hour, txn_seq
  FROM stg
)"""

LEVELS = {"ev": [EV], "landing": [EV, LANDING], "silver": [EV, LANDING, SILVER],
          "stg": [EV, LANDING, SILVER, STG]}


def with_base(body: str, upto: str = "stg", extra: list[str] | None = None) -> str:
    ctes = LEVELS[upto] + (extra or [])
    return "WITH " + ",\n".join(ctes) + "\n" + body


def stable_select(inner: str, doubles: list[str]) -> str:
    """Round the DOUBLE outputs the same way the Spark side does."""
    if not doubles:
        return inner
    repl = ", ".join(f"CAST(round(CAST(\"{c}\" AS DECIMAL(38,12)), 6) AS DOUBLE) AS \"{c}\""
                     for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{inner}\n) AS q"


def r(expr: str, digits: int) -> str:
    """Half-up rounding at the 12-decimal value (same as ``round_half_up``)."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,12)), {digits}) AS DOUBLE)"
