"""Models kept up by increments: mergeable partials per partition hour.

Each warehouse hour is aggregated once into small *state* rows per (hour, key): counts, sums,
extremes, and the moments (n, mean, sum of squared differences) of the amount.  States merge in
any order, so late hours need nothing special.  A model's *totals* hold one merged state for each
key over all hours.  An update takes

* the totals of keys that no replaced or lost hour touches, as they are;
* for touched keys, their states in all hours that now count (the totals cannot forget an hour);
* the states of the new hours;

and merges these rows by key: one aggregation, and no fact row is read again.  The senders of a
merchant are a counted multiset, (merchant, sender, n): whole numbers, so an hour is taken out by
subtracting it.  Hours and types have a handful of keys and are merged from all hours' states.

Rows without a user or merchant are one key; rows without an amount count as rows and are in no
sum, average or deviation.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.functions.columns import is_night_hour
from txnlake.operators import models as M
from txnlake.schemas import PARTITION_KEYS

MOMENTS = ["amount_count", "amount_mean", "amount_m2"]


def _moments() -> list[Column]:
    n = F.count("amount")
    return [n.alias("amount_count"), F.avg("amount").alias("amount_mean"),
            (F.var_pop("amount") * n).alias("amount_m2")]


def _merged_moments() -> Column:
    """Moments of several groups: deviations from the common mean, group by group."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))

    some = F.when(F.col("amount_count") > 0, F.struct(
        F.col("amount_count").alias("n"), F.col("amount_mean").alias("mean"),
        F.col("amount_m2").alias("m2")))
    return F.aggregate(F.collect_list(some), zero, merge)


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def _is(col: str) -> Column:
    return F.col(col) == 1


class State:
    """One kind of state: its keys, how a row is aggregated, and which columns merge how."""

    def __init__(self, keys: list[str], sums: dict[str, callable], least: dict[str, str] = {},
                 most: dict[str, str] = {}, only: callable = None, moments: bool = True):
        self.keys, self.sums, self.least, self.most = keys, sums, least, most
        self.only, self.moments = only, moments

    def of_hours(self, fact: DataFrame) -> DataFrame:
        """The states of all hours of the rows."""
        rows = fact.filter(self.only()) if self.only else fact
        return rows.groupBy(*PARTITION_KEYS, *self.keys).agg(
            *(f().alias(c) for c, f in self.sums.items()),
            *(F.min(src).alias(c) for c, src in self.least.items()),
            *(F.max(src).alias(c) for c, src in self.most.items()),
            *(_moments() if self.moments else []))

    def merged(self, states: DataFrame) -> DataFrame:
        """One state for each key."""
        got = states.groupBy(*self.keys).agg(
            *(F.sum(c).alias(c) for c in self.sums), *(F.min(c).alias(c) for c in self.least),
            *(F.max(c).alias(c) for c in self.most),
            *([_merged_moments().alias("_m")] if self.moments else []))
        if not self.moments:
            return got
        return got.select(*[c for c in got.columns if c != "_m"], F.col("_m.n").alias("amount_count"),
                          F.when(F.col("_m.n") > 0, F.col("_m.mean")).alias("amount_mean"),
                          F.when(F.col("_m.n") > 0, F.col("_m.m2")).alias("amount_m2"))

    def _of(self, df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """Rows of the keys (left_semi) or of all others (left_anti); NULL is a key."""
        other = keys.select(*(F.col(k).alias(f"_{k}") for k in self.keys))
        same = functools.reduce(Column.__and__, (df[k].eqNullSafe(other[f"_{k}"]) for k in self.keys))
        return df.join(other, same, how)

    def updated(self, totals: DataFrame, new: DataFrame, taken_out: DataFrame | None = None,
                kept: DataFrame | None = None) -> DataFrame:
        """The totals after the states `new` came in.  `taken_out`: the states that replaced and
        lost hours had; `kept`: the states of all other old hours."""
        if taken_out is None:
            return self.merged(totals.unionByName(new.drop(*PARTITION_KEYS)))
        touched = taken_out.select(*self.keys).distinct()
        rows = self._of(totals, touched, "left_anti").unionByName(
            self._of(kept, touched, "left_semi").drop(*PARTITION_KEYS)).unionByName(
            new.drop(*PARTITION_KEYS))
        return self.merged(rows)


def _sum(col: str):
    return lambda: F.sum(F.col(col).cast("long"))


_ROWS = {"total_txns": lambda: F.count(F.lit(1)), "total_volume": lambda: F.sum("amount"),
         "fraud_count": _sum("is_fraud")}

USER = State(["user_id"], {
    **_ROWS,
    "emptied_account_count": lambda: _count(_is("is_all_orig_balance")),
    "to_new_account_count": lambda: _count(_is("is_dest_zero_init")),
    "balance_error_count": lambda: _count(_is("is_error_balance_orig") | _is("is_error_balance_dest")),
    "transfer_count": _sum("is_transfer"), "cash_out_count": _sum("is_cash_out"),
    "night_txns": lambda: _count(is_night_hour(F.col("hour_of_day"))),
}, {"first_seen": "transaction_time"}, {"last_seen": "transaction_time", "max_txn_amount": "amount"})

MERCHANT = State(["merchant_id"], _ROWS, most={"max_received_amount": "amount"},
                 only=lambda: F.col("is_merchant_dest") == 1)

SENDERS = State(["merchant_id", "user_id"], {"n": lambda: F.count(F.lit(1))},
                only=lambda: F.col("is_merchant_dest") == 1, moments=False)

CLOCK = State(["hour_of_day", "day_of_week"], {
    **_ROWS,
    "fraud_amount": lambda: F.sum(F.when(_is("is_fraud"), F.col("amount")).otherwise(F.lit(0.0))),
    "fraud_transfers": lambda: _count(_is("is_fraud") & _is("is_transfer")),
    "fraud_cash_outs": lambda: _count(_is("is_fraud") & _is("is_cash_out")),
}, moments=False)
CLOCK.sums["amount_count"] = lambda: F.count("amount")

TYPE = State(["type"], {
    **_ROWS, "amount_count": lambda: F.count("amount"),
    "fraud_volume": lambda: F.sum(F.when(_is("is_fraud"), F.col("amount")).otherwise(F.lit(0.0))),
    "fraud_amounts": lambda: F.count(F.when(_is("is_fraud"), F.col("amount"))),
    "balance_error_orig_count": _sum("is_error_balance_orig"),
    "balance_error_dest_count": _sum("is_error_balance_dest"),
    "emptied_account_count": _sum("is_all_orig_balance"),
    "new_dest_account_count": _sum("is_dest_zero_init"),
    "fraud_sum": lambda: F.sum(F.when(_is("is_fraud"), F.col("amount"))),
}, {"min_amount": "amount"}, {"max_amount": "amount"}, moments=False)

STATES = {"user": USER, "merchant": MERCHANT, "senders": SENDERS, "clock": CLOCK, "type": TYPE}
#: Kinds whose totals are kept; the others have few keys and are merged from all states.
KEPT_TOTALS = ("user", "merchant", "senders")


def updated_senders(totals: DataFrame, new: DataFrame, taken_out: DataFrame | None = None) -> DataFrame:
    """The multiset of (merchant, sender) with the new hours in and the old ones out."""
    rows = totals.unionByName(new.drop(*PARTITION_KEYS))
    if taken_out is not None:
        rows = rows.unionByName(taken_out.drop(*PARTITION_KEYS).withColumn("n", -F.col("n")))
    return SENDERS.merged(rows).filter("n > 0")


def _mean(total: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.col(total) / F.col(n))


def user_profile(totals: DataFrame) -> DataFrame:
    """Dimension and behaviour columns of each user, from the totals."""
    return totals.withColumns({
        "avg_txn_amount": _mean("total_volume", "amount_count"), "updated_at": F.col("last_seen"),
        "amount_volatility": F.sqrt(F.col("amount_m2") / F.col("amount_count"))}).drop(*MOMENTS)


def dim_users(totals: DataFrame) -> DataFrame:
    return user_profile(totals).select(
        "user_id", "first_seen", "last_seen", "total_txns", "total_volume", "fraud_count",
        "avg_txn_amount", "updated_at")


def mart_user_risk_score(totals: DataFrame) -> DataFrame:
    return M.risk_score_columns(user_profile(totals))


def mart_merchant_risk(totals: DataFrame, senders: DataFrame) -> DataFrame:
    """From the merchants' totals and the multiset of their senders."""
    s = senders.groupBy(F.col("merchant_id").alias("_m")).agg(
        F.count("user_id").alias("unique_senders"))  # a missing sender is none
    return totals.join(s, totals["merchant_id"].eqNullSafe(s["_m"]), "left").select(
        "merchant_id", F.col("total_txns").alias("total_incoming_txns"),
        F.col("total_volume").alias("total_received_volume"),
        _mean("total_volume", "amount_count").alias("avg_received_amount"), "max_received_amount",
        F.sqrt(F.col("amount_m2") / F.col("amount_count")).alias("stddev_received_amount"),
        F.col("fraud_count").alias("fraud_received_count"),
        F.coalesce("unique_senders", F.lit(0)).alias("unique_senders"),
        (F.col("fraud_count").cast("double") / F.col("total_txns")).alias("fraud_risk_ratio"))


def mart_hourly_patterns(states: DataFrame) -> DataFrame:
    return M.hourly_pattern_columns(CLOCK.merged(states).withColumns({
        "total_amount": F.col("total_volume"),
        "avg_txn_amount": _mean("total_volume", "amount_count")}))


def mart_transaction_type_analysis(states: DataFrame) -> DataFrame:
    return M.type_analysis_columns(TYPE.merged(states).select(
        "*", F.col("total_volume").alias("_sum"), _mean("total_volume", "amount_count").alias("_avg"),
        F.col("min_amount").alias("_min"), F.col("max_amount").alias("_max"),
        F.col("fraud_volume").alias("_fsum"), _mean("fraud_sum", "fraud_amounts").alias("_favg")))
