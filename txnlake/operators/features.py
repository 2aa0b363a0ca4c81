"""Leak-free windowed features per recipient (`dest_`) and sender (`orig_`).

Semantics (per key, over the rows of the read window):
* `*_delta_seconds`   seconds since the key's previous transaction (NULL for the first)
* `*_msg_count_1h/24h`, `*_amount_sum_1h/24h`: rows with `ts_seconds` in
  `[t - 3600, t - 1]` / `[t - 86400, t - 1]` -- the row itself *and* same-second
  peers are excluded (RANGE frame on whole seconds)
* `*_count_past`, `*_sum_amount_past`, `*_history_fraud_count` (and for senders
  `orig_avg_amount_past`, `orig_prev_amount`): all earlier rows of the key
  (ROWS frame `UNBOUNDED PRECEDING .. 1 PRECEDING`)
* empty frame: count 0, sum/avg/lag NULL.
Rows are ordered by (ts_seconds, transaction_time, tie-break id); ts_seconds is
monotone in transaction_time, so one sort serves both the ROWS and RANGE frames.

Every frame is a difference of running sums, for every key and size.  A row is an event that
comes in at its second, and leaves each range frame `length` seconds later; the sums of what has
come in less what has gone out, over the events of earlier seconds, are the frame's content.  So
one sort by (key, second) and one pass do; no frame slides over its rows again, and a key with
all its rows in one day costs n log n like any other.

Hot keys.  A plain window puts all of a key's history in one task; a hot merchant holding a third
of 100 TB would never finish.  Keys with more than `max_key_rows` rows are therefore split into
time buckets.  Which ones is counted first (map-side combined); where there are none, nothing more is
planned.  Otherwise events go through the same one exchange on (key,
bucket), and the totals of all earlier buckets, from an aggregate of hot keys x buckets windowed
per key, are added to the running sums; `lag` falls back to the last row of an earlier bucket.

Amounts are summed as DECIMAL(28,6), which has one result in any order, so neither the split
nor the differences show in any digit.  An amount beyond that type (NaN, infinite, 1e22 and
more) counts as a row without an amount: it is in no sum or average.  Rows without a time sort
first; they are each other's peers in the RANGE frames, as a window has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.functions.columns import amount_log, night_flag, round_amount_flag
from txnlake.schemas import FEATURE_ROW_COLUMNS, SEQ_COL
from txnlake.session import materialize

# Fixed frame lengths of the reference features.
RANGES = {"1h": 3600, "24h": 86400}
MINUTE_SECONDS = 60
NULL_KEY = "\u0000null"  # groups NULL keys together, like a window partition does
NULL_KEY_SQL = r"\u0000null"

# Without a unique id, a hash of the columns that the features read orders same-time rows
# (rows equal on all of them are interchangeable).
HASH_TIEBREAK = ["transaction_time", "user_id", "merchant_id", "amount", "isFraud"]


# A key with more rows than this is "hot": its whole history would be one task.
MAX_KEY_ROWS = 1_000_000
# Amounts are summed exactly in this type.
EXACT = "decimal(28,6)"
WHOLE = 0  # the one bucket of a key that is not split
NO_TIME = -(1 << 62)  # the bucket of rows without a time, before all others
BEFORE_TIME = -(1 << 60)  # a second before all others


def hot_keys(df: DataFrame, key: Column, max_key_rows: int) -> DataFrame:
    """(_k): keys with more than `max_key_rows` rows.  Counts combine map-side; at most
    rows / max_key_rows keys pass, which bounds their broadcast."""
    return (df.select(key.alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > max_key_rows).select("_k"))


def bucket_of(hot: Column, ts: Column, seconds: int) -> Column:
    return F.when(hot, F.coalesce(F.floor(ts / F.lit(seconds)), F.lit(NO_TIME))) \
        .otherwise(F.lit(WHOLE))


def _events(df: DataFrame, key: str, ranges: dict[str, int], seq: str | None,
            keep: bool) -> DataFrame:
    """(_k, _t, _out, _row, ...): each row as it comes in at second _t (_out 0) and goes out of
    the i-th range (_out i); only what comes in keeps the row."""
    tie = f"`{seq}`" if seq and seq in df.columns else \
        f"xxhash64({', '.join(f'`{c}`' for c in HASH_TIEBREAK if c in df.columns)})"
    row = f"struct({', '.join(f'`{c}`' for c in df.columns)})" if keep else "1"
    one = df.selectExpr(
        f"{row} AS _r", f"coalesce(`{key}`, '{NULL_KEY_SQL}') AS _k",
        "cast(cast(transaction_time AS timestamp) AS bigint) AS _ts",
        "cast(transaction_time AS timestamp) AS _time", "amount AS _amount",
        f"try_cast(amount AS {EXACT}) AS _x", "isFraud AS _fraud", f"{tie} AS _tie")
    comes = "named_struct('_t', _ts, '_out', 0, '_row', _r)"
    # rows without a time leave every frame before the first second
    goes = [f"named_struct('_t', coalesce(_ts + {secs}, {BEFORE_TIME}), '_out', {i}, "
            "'_row', if(false, _r, null))" for i, secs in enumerate(ranges.values(), 1)]
    return one.selectExpr("_k", "_time", "_amount", "_x", "_fraud", "_tie", "_ts",
                          f"inline(array({', '.join([comes, *goes])}))")


def key_window_features(df: DataFrame, key: str, prefix: str, *,
                        seq: str | None = SEQ_COL, bucket_seconds: int = MINUTE_SECONDS,
                        ranges: dict[str, int] | None = None,
                        prev_amount: bool = False, avg_past: bool = False,
                        totals_from: DataFrame | None = None,
                        max_key_rows: int = MAX_KEY_ROWS,
                        carried: DataFrame | None = None,
                        hot: DataFrame | str | None = "count") -> DataFrame:
    """Add the `prefix`-named window features of one key (plan: see module doc).

    `totals_from`: the same rows with fewer derived columns, to count keys and total
    hot ones without running `df`'s own windows again.  `carried`: a row for each key with the
    totals of all rows before those of `df` (`carried_state`).  `hot`: the keys (_k) to split, if
    they have been counted; None if there are none.
    """
    ranges = ranges or RANGES
    src = totals_from if totals_from is not None else df
    if isinstance(hot, str):
        hot = hot_keys(src, F.coalesce(F.col(key), F.lit(NULL_KEY)), max_key_rows)
        hot = None if hot.isEmpty() else materialize(hot)
    split = hot is not None
    bucket = f"coalesce(floor(_t / {bucket_seconds}), {NO_TIME})"

    # Of each range, rows, amounts and their sum: what comes in counts up, what goes out down.
    moved = {f"{c}{i}": f"sum(if(_out = 0, {v}, if(_out = {i}, -{v}, 0)))"
             for i in range(1, len(ranges) + 1)
             for c, v in (("_n", "1"), ("_a", "if(_x IS NULL, 0, 1)"), ("_s", "coalesce(_x, 0)"))}
    past = {"_n0": "sum(if(_out = 0, 1, 0))", "_a0": "sum(if(_out = 0 AND _x IS NOT NULL, 1, 0))",
            "_s0": "sum(if(_out = 0, _x, null))", "_f0": "sum(if(_out = 0, _fraud, null))"}
    last = "if(_out = 0, struct(_time AS t, _amount AS a), null)"

    events = _events(df, key, ranges, seq, True)
    if split:  # at most rows / max_key_rows keys
        events = events.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_k", "left") \
            .withColumn("_b", F.expr(f"if(_hot, {bucket}, {WHOLE})"))
    by = "PARTITION BY _k, _b" if split else "PARTITION BY _k"
    ranged = f"({by} ORDER BY _t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rows = f"({by} ORDER BY _t, _time, _tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    events = events.selectExpr(
        "*", *(f"{v} OVER {rows} AS {c}" for c, v in past.items()),
        f"last_value({last}) IGNORE NULLS OVER {rows} AS _last")
    events = events.selectExpr("*", *(f"{v} OVER {ranged} AS {c}" for c, v in moved.items())) \
        .where("_out = 0")

    if split:
        totals = _events(src, key, ranges, seq, False).join(F.broadcast(hot), "_k", "left_semi") \
            .withColumn("_b", F.expr(bucket))
        totals = totals.groupBy("_k", "_b").agg(
            *(F.expr(v).alias(c) for c, v in (past | moved).items()),
            F.expr("max(if(_out = 0, struct(_ts, _time AS t, _tie, _amount AS a), null))").alias("_last"))
        earlier = "OVER (PARTITION BY _k ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        offsets = totals.selectExpr(
            "_k AS _ok", "_b AS _ob", *(f"sum({c}) {earlier} AS _o{c}" for c in past | moved),
            f"last_value(_last) IGNORE NULLS {earlier} AS _o_last")
        events = events.join(offsets, (F.col("_k") == F.col("_ok")) & (F.col("_b") == F.col("_ob")),
                             "left")

    if carried is not None:  # keyed like the windows: no exchange of the rows
        events = events.join(carried, F.col("_k") == F.col("_ck"), "left")

    def total(c: str) -> str:
        """The running sum in the bucket, that of all earlier ones and what is carried; NULL if
        all are."""
        got = c
        for more in ["_o"] * split + ["_c"] * (carried is not None and c in past):
            got = f"coalesce({got} + {more}{c}, {got}, {more}{c})"
        return got

    def of_last(c: str) -> str:
        lasts = ["_last", *["_o_last"] * split, *["_c_last"] * (carried is not None)]
        pick = f"{lasts[-1]}.{c}"
        for x in reversed(lasts[:-1]):
            pick = f"if({x} IS NULL, {pick}, {x}.{c})"
        return pick

    out = {}
    for i, label in enumerate(ranges, 1):
        out[f"{prefix}_msg_count_{label}"] = f"cast(coalesce({total(f'_n{i}')}, 0) AS bigint)"
        out[f"{prefix}_amount_sum_{label}"] = f"if({total(f'_a{i}')} > 0, " \
                                              f"cast({total(f'_s{i}')} AS double), null)"
    sums = f"cast({total('_s0')} AS double)"
    out |= {
        f"{prefix}_delta_seconds": f"_ts - cast({of_last('t')} AS bigint)",
        f"{prefix}_count_past": f"cast(coalesce({total('_n0')}, 0) AS bigint)",
        f"{prefix}_sum_amount_past": sums,
        f"{prefix}_history_fraud_count": total("_f0"),
    }
    if prev_amount:
        out[f"{prefix}_prev_amount"] = of_last("a")
    if avg_past:
        out[f"{prefix}_avg_amount_past"] = f"if({total('_a0')} > 0, {sums} / {total('_a0')}, null)"
    return events.selectExpr("_row.*", *(f"{v} AS {c}" for c, v in out.items()))


# ------------------------------------------------------------ a day at a time

def daily_totals(silver: DataFrame, key: str, seq: str | None = SEQ_COL) -> DataFrame:
    """The state that days leave behind for each (key, part_dt): rows, amounts, their exact sum,
    frauds, and the last row."""
    tie = F.col(seq) if seq and seq in silver.columns else F.xxhash64(
        *[F.col(c) for c in HASH_TIEBREAK if c in silver.columns])
    t = F.col("transaction_time").cast("timestamp")
    x = F.col("amount").try_cast(EXACT)
    return silver.groupBy(F.coalesce(F.col(key), F.lit(NULL_KEY)).alias("_ck"), "part_dt").agg(
        F.count(F.lit(1)).alias("n"), F.count(x).alias("a"), F.sum(x).alias("s"), F.sum("isFraud").alias("f"),
        F.max(F.struct(t.cast("long").alias("ts"), t.alias("t"), tie.alias("tie"),
                       F.col("amount").alias("a"))).alias("last"))


def carried_state(totals: DataFrame, first_dt: str, before_dt: str) -> DataFrame:
    """What a run of one day is given of the dates `first_dt` to before `before_dt`: one row for each
    key, from a few rows of state, however many transactions they stand for."""
    held = totals.filter((F.col("part_dt") >= first_dt) & (F.col("part_dt") < before_dt))
    return held.groupBy("_ck").agg(
        F.sum("n").alias("_c_n0"), F.sum("a").alias("_c_a0"), F.sum("s").alias("_c_s0"),
        F.sum("f").alias("_c_f0"), F.max("last").alias("_c_last"))


def day_window_features(two_days: DataFrame, dest_totals: DataFrame, orig_totals: DataFrame,
                        first_dt: str, yesterday: str, today: str, **kw) -> DataFrame:
    """The features of the rows of date `today`, as a run over all dates from `first_dt` on gives them,
    from the rows of today and yesterday (the ranges reach back 24 hours at most) and the daily
    totals of the dates before.  Rows lie in the date of their time."""
    df = two_days.filter(F.col("part_dt").isin(yesterday, today))
    df = key_window_features(df, "merchant_id", "dest", carried=carried_state(
        dest_totals, first_dt, yesterday), **kw)
    df = key_window_features(df, "user_id", "orig", prev_amount=True, avg_past=True, totals_from=two_days.filter(
        F.col("part_dt").isin(yesterday, today)), carried=carried_state(orig_totals, first_dt, yesterday), **kw)
    return feature_projection(pattern_features(df.filter(F.col("part_dt") == today)))


def dest_window_features(df: DataFrame, **kw) -> DataFrame:
    return key_window_features(df, "merchant_id", "dest", **kw)


def orig_window_features(df: DataFrame, **kw) -> DataFrame:
    return key_window_features(df, "user_id", "orig", prev_amount=True, avg_past=True, **kw)


def pattern_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_night_txn": night_flag("hour_of_day"),
        "is_round_amount": round_amount_flag("amount"),
        "amount_log": amount_log("amount"),
    })


def feature_projection(df: DataFrame) -> DataFrame:
    """Final feature-store row (31 columns, plus the tie-break id when present)."""
    cols = [F.col("isFraud").alias("is_fraud") if c == "is_fraud" else F.col(c)
            for c in FEATURE_ROW_COLUMNS]
    if SEQ_COL in df.columns:
        cols.append(F.col(SEQ_COL))
    return df.select(*cols)


def hot_of_both(df: DataFrame, max_key_rows: int) -> dict[str, DataFrame | None]:
    """The hot recipients and senders, counted in one pass."""
    keys = ", ".join(f"struct('{k}' AS _c, coalesce(`{k}`, '{NULL_KEY_SQL}') AS _k)"
                     for k in ("merchant_id", "user_id"))
    both = df.selectExpr(f"inline(array({keys}))").groupBy("_c", "_k").count().where(
        F.col("count") > max_key_rows).select("_c", "_k")
    if both.isEmpty():
        return {"merchant_id": None, "user_id": None}
    both = materialize(both)
    return {k: both.where(F.col("_c") == k).select("_k") for k in ("merchant_id", "user_id")}


def window_features(silver: DataFrame, max_key_rows: int = MAX_KEY_ROWS, **kw) -> DataFrame:
    """The whole feature job: recipient windows, sender windows, pattern flags, projection."""
    hot = hot_of_both(silver, max_key_rows)
    df = dest_window_features(silver, hot=hot["merchant_id"], **kw)
    df = orig_window_features(df, totals_from=silver, hot=hot["user_id"], **kw)
    return feature_projection(pattern_features(df))
