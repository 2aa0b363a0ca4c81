"""Registered queries: models kept up by increments, against a build over the final rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnlake.operators import rollup as R
from txnlake.plans import queries_core as core
from txnlake.plans.base import fact_df
from txnlake.plans.oracle_sql import with_base
from txnlake.plans.registry import register
from txnlake.sources import sinks as K

# The first load lacks the late hours and the newest days, holds other amounts and a sender more in
# the hours that are loaded again, and the hours of a day that is lost later.  Some rows have no
# sender, some no amount.
LATE = "(part_hour IN ('08', '09') AND CAST(part_dt AS INT) % 3 = 0)"
NEWEST = "part_dt >= '20240125'"
RERUN = "part_hour = '12'"
LOST = "part_dt = '20240112'"
NO_USER, NO_AMOUNT = "txn_seq % 97 = 5", "txn_seq % 89 = 3"

HELD = f""", held AS (SELECT * REPLACE (
  CASE WHEN {NO_USER} THEN NULL ELSE user_id END AS user_id,
  CASE WHEN {NO_AMOUNT} THEN NULL ELSE amount END AS amount) FROM fact WHERE NOT ({LOST}))
"""


def _sql(body: str) -> str:
    return with_base(HELD + body.replace("FROM fact", "FROM held"))


def _loads(spark, sf):
    """The rows of the first load, of the late and new hours, and of the hours loaded again."""
    fact = fact_df(spark, sf)
    fact = fact.withColumns({
        "user_id": F.when(~F.expr(NO_USER), F.col("user_id")),
        "amount": F.when(~F.expr(NO_AMOUNT), F.col("amount"))})
    first = fact.filter(f"NOT {LATE} AND NOT {NEWEST}")
    stale = F.expr(f"{RERUN} AND NOT ({LOST})")
    first = first.withColumns({
        "amount": F.when(stale, F.col("amount") + 5).otherwise(F.col("amount")),
        "user_id": F.when(stale & (F.col("txn_seq") % 7 == 0), F.lit("C-gone")).otherwise(F.col("user_id"))})
    return (first, fact.filter(f"({LATE} OR {NEWEST}) AND NOT ({LOST})"),
            fact.filter(f"{RERUN} AND NOT ({LATE}) AND NOT {NEWEST} AND NOT ({LOST})"))


def kept_up(spark, sf, kind: str):
    """Totals and live states after three loads: the first, late and new hours, then hours loaded
    again and lost."""
    state = R.STATES[kind]
    first, new, again = (K.stored(state.of_hours(x), f"states-{kind}") for x in _loads(spark, sf))
    out = F.expr(f"({RERUN} OR {LOST})")
    taken, stay = first.filter(out), first.filter(~out).unionByName(new)
    totals = K.stored(state.merged(first), f"totals-{kind}")
    if kind == "senders":
        totals = K.stored(R.updated_senders(totals, new), "totals")
        return R.updated_senders(totals, again, taken), stay.unionByName(again)
    totals = K.stored(state.updated(totals, new), f"totals-{kind}")
    return state.updated(totals, again, taken, stay), stay.unionByName(again)


@register("dim_users_kept_up", _sql(core.DIM_SQL.format(src="fact")), core.DIM_DOUBLES)
def q_dim(spark, sf):
    """The user dimension after late, new, re-run and lost hours: equal to a build of what is there."""
    return R.dim_users(kept_up(spark, sf, "user")[0])


@register("mart_user_risk_score_kept_up", _sql(core._risk_sql(core.DIM_SQL.format(src="fact")).replace(
    "u.user_id = b.user_id", "u.user_id IS NOT DISTINCT FROM b.user_id")), core.RISK_DOUBLES)
def q_risk(spark, sf):
    return R.mart_user_risk_score(kept_up(spark, sf, "user")[0])


@register("mart_merchant_risk_kept_up", _sql(core.MERCHANT_SQL),
          ("total_received_volume", "avg_received_amount", "max_received_amount",
           "stddev_received_amount", "fraud_risk_ratio"))
def q_merchant(spark, sf):
    """Moments merged, senders counted in and out."""
    return R.mart_merchant_risk(kept_up(spark, sf, "merchant")[0], kept_up(spark, sf, "senders")[0])


@register("mart_hourly_patterns_kept_up", _sql(core.HOURLY_SQL),
          ("fraud_rate_pct", "total_amount", "fraud_amount", "avg_txn_amount"))
def q_hourly(spark, sf):
    return R.mart_hourly_patterns(kept_up(spark, sf, "clock")[1])


@register("mart_transaction_type_analysis_kept_up", core.TYPE_MART_SQL.replace(
    "\n\nSELECT type", "\n" + HELD + "SELECT type").replace("FROM fact GROUP", "FROM held GROUP"),
    core.TYPE_MART_DOUBLES)
def q_types(spark, sf):
    return R.mart_transaction_type_analysis(kept_up(spark, sf, "type")[1])
