"""Registered queries: model steps (section 2.10).  Metric keys use a rule-based
prediction so SQL can check them; trained-model keys are rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnlake.functions.columns import epoch_seconds
from txnlake.operators import features as FT
from txnlake.operators import ml as ML
from txnlake.operators import models as M
from txnlake.plans.base import fact_df, silver_df
from txnlake.plans.oracle_sql import with_base
from txnlake.plans.queries_core import ANOMALY_CTE
from txnlake.plans.queries_features import FEATURE_DOUBLES, FEATURE_EXPR, _feature_sql
from txnlake.plans.registry import register
from txnlake.session import materialize, scratch_path

ELIGIBLE = "fact WHERE type IN ('CASH_OUT', 'TRANSFER')"


def _eligible_fact(spark, sf):
    return ML.fraud_eligible_filter(fact_df(spark, sf))


def _training_frame(spark, sf):
    """Feature rows of fraud-eligible types, class-weighted, NULLs filled."""
    feats = materialize(ML.fraud_eligible_filter(FT.window_features(silver_df(spark, sf))))
    return ML.null_fill(ML.class_weights(feats))


def _split(spark, sf):
    df = _training_frame(spark, sf)
    train, test, _ = ML.time_split(df)
    return df, train, test


SPLIT_CTE = f"""
, e AS (SELECT txn_seq, is_fraud, epoch_us(transaction_time) // 1000000 AS ts_seconds FROM {ELIGIBLE}),
r AS (SELECT ts_seconds, row_number() OVER (ORDER BY ts_seconds) AS rn, count(*) OVER () AS n FROM e),
t AS (SELECT ts_seconds AS thr FROM r WHERE rn = CAST(greatest(ceil(0.8 * n), 1) AS BIGINT))
"""
# What a model predicts is checked by its form; which rows it is tested on, by their ids.
TESTED_SQL = with_base(SPLIT_CTE + """SELECT txn_seq, is_fraud, true AS sound FROM e
WHERE ts_seconds > (SELECT thr FROM t)""")


def _tested(scored):
    """The rows of a test set; `sound`: a probability, and the prediction that follows."""
    p = F.col("fraud_probability")
    return scored.select("txn_seq", "is_fraud", (
        p.between(0, 1) & F.col("prediction").isin(0.0, 1.0)
        & (((p > 0.5) == (F.col("prediction") == 1)) | (p == 0.5))).alias("sound"))


def _predictions(spark, sf, model_type):
    df, train, test = _split(spark, sf)
    return _tested(ML.score_transactions(
        ML.train(train, ML.available_features(df), model_type), test))


@register("class_weights", with_base(f"""
, c AS (SELECT CASE WHEN count(*) FILTER (WHERE is_fraud = 0) = 0 THEN 1
                    ELSE count(*) FILTER (WHERE is_fraud = 0) END AS n0,
               CASE WHEN count(*) FILTER (WHERE is_fraud = 1) = 0 THEN 1
                    ELSE count(*) FILTER (WHERE is_fraud = 1) END AS n1 FROM {ELIGIBLE})
SELECT txn_seq, is_fraud,
  CASE WHEN is_fraud = 1 THEN (SELECT n0::DOUBLE / n1 FROM c) ELSE 1.0 END AS weight
FROM {ELIGIBLE}"""), ("weight",))
def q_class_weights(spark, sf):
    return ML.class_weights(_eligible_fact(spark, sf)).select("txn_seq", "is_fraud", "weight")


@register("snapshot_summary", with_base(f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE is_fraud = 1) AS frauds,
  count(*) FILTER (WHERE is_fraud = 1) * 100.0::DOUBLE / count(*) AS fraud_pct FROM {ELIGIBLE}"""),
    ("fraud_pct",))
def q_snapshot_summary(spark, sf):
    return ML.snapshot_summary(_eligible_fact(spark, sf))


NULLABLE = ["orig_delta_seconds", "dest_delta_seconds", "dest_amount_sum_1h",
            "dest_amount_sum_24h", "dest_sum_amount_past", "dest_history_fraud_count",
            "orig_amount_sum_1h", "orig_amount_sum_24h", "orig_prev_amount",
            "orig_sum_amount_past", "orig_avg_amount_past", "orig_history_fraud_count"]


@register("null_fill", with_base(
    ", f AS (SELECT *, epoch_us(transaction_time) // 1000000 AS ts FROM silver)\n"
    "SELECT txn_seq, " + ", ".join(
        f"coalesce({FEATURE_EXPR[c]}, {'0.0' if c in FEATURE_DOUBLES else '0'}) AS {c}"
        for c in NULLABLE) + " FROM f", "silver"),
    tuple(c for c in NULLABLE if c in FEATURE_DOUBLES))
def q_null_fill(spark, sf):
    return ML.null_fill(FT.window_features(silver_df(spark, sf))).select("txn_seq", *NULLABLE)


@register("time_split", with_base(SPLIT_CTE + """
SELECT txn_seq, ts_seconds,
  CASE WHEN ts_seconds <= (SELECT thr FROM t) THEN 'train' ELSE 'test' END AS split
FROM e"""))
def q_time_split(spark, sf):
    """The split that training uses: exact 0.8 quantile of time -> train/test for each row."""
    train, test, _ = ML.time_split(_eligible_fact(spark, sf))
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))).select(
        "txn_seq", epoch_seconds("transaction_time").alias("ts_seconds"), "split")


_AVAILABLE = [c for c in ML.FEATURE_COLS if c in FEATURE_EXPR or c in (
    "amount", "hour_of_day", "day_of_week", "is_transfer", "is_cash_out")]


@register("available_features", _feature_sql([c for c in _AVAILABLE if c in FEATURE_EXPR]),
          FEATURE_DOUBLES)
def q_available_features(spark, sf):
    feats = FT.window_features(silver_df(spark, sf))
    base = ["transaction_time", "user_id", "merchant_id", "amount", "type", "is_fraud",
            "hour_of_day", "day_of_week", "is_transfer", "is_cash_out"]
    cols = list(dict.fromkeys(base + ML.available_features(feats)))
    return feats.select(*cols, "txn_seq")


SCALED = [f"s_{c}" for c in _AVAILABLE]


def _scale_sql() -> str:
    filled = ", ".join(f"CAST(coalesce({FEATURE_EXPR.get(c, c)}, 0) AS DOUBLE) AS {c}"
                       for c in _AVAILABLE)
    scaled = ", ".join(f"CASE WHEN stddev_samp({c}) OVER () > 0 THEN {c} / stddev_samp({c}) OVER () "
                       f"ELSE 0.0 END AS s_{c}" for c in _AVAILABLE)
    return with_base(
        ", f AS (SELECT *, epoch_us(transaction_time) // 1000000 AS ts FROM silver),\n"
        f"g AS (SELECT txn_seq, type, {filled} FROM f),\n"
        "h AS (SELECT * FROM g WHERE type IN ('CASH_OUT', 'TRANSFER'))\n"
        f"SELECT txn_seq, {scaled} FROM h", "silver")


@register("assemble_scale", _scale_sql(), tuple(SCALED))
def q_assemble_scale(spark, sf):
    """Every training feature over its sample deviation, a column each."""
    df = _training_frame(spark, sf)
    feats = ML.available_features(df)
    return ML.assemble_scale(df, feats).select(
        "txn_seq", *[F.col("scaled")[i].alias(f"s_{c}") for i, c in enumerate(feats)])


@register("train_lr", TESTED_SQL)
def q_train_lr(spark, sf):
    return _predictions(spark, sf, "lr")


@register("train_rf", TESTED_SQL)
def q_train_rf(spark, sf):
    return _predictions(spark, sf, "rf")


@register("train_gbt", TESTED_SQL)
def q_train_gbt(spark, sf):
    return _predictions(spark, sf, "gbt")


@register("tune_cv", TESTED_SQL)
def q_tune_cv(spark, sf):
    df, train, test = _split(spark, sf)
    best = ML.tune_cv(train, ML.available_features(df), "lr")
    return _tested(ML.score_transactions(best, test))


@register("score_transactions", with_base(SPLIT_CTE + "SELECT txn_seq, is_fraud, true AS sound FROM e"))
def q_score(spark, sf):
    """Every eligible row, scored."""
    df, train, _ = _split(spark, sf)
    return _tested(ML.score_transactions(ML.train_lr(train, ML.available_features(df)), df))


AUC_SQL = """
, g AS (SELECT anomaly_score AS s, count(*) FILTER (WHERE is_fraud = 1) AS p,
               count(*) FILTER (WHERE is_fraud = 0) AS n FROM b GROUP BY anomaly_score),
c AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn
      FROM g WINDOW w AS (ORDER BY s DESC)),
x AS (SELECT s, tp::DOUBLE / np AS tpr, fp::DOUBLE / nn AS fpr, tp::DOUBLE / (tp + fp) AS prec FROM c),
y AS (SELECT tpr, fpr, prec, coalesce(lag(tpr) OVER w, 0.0) AS tpr0, coalesce(lag(fpr) OVER w, 0.0) AS fpr0,
             coalesce(lag(prec) OVER w, prec) AS prec0 FROM x WINDOW w AS (ORDER BY s DESC))
SELECT sum((fpr - fpr0) * (tpr + tpr0) / 2) AS auc_roc,
       sum((tpr - tpr0) * (prec + prec0) / 2) AS auc_pr FROM y"""


@register("auc_metrics", with_base(AUC_SQL, extra=[ANOMALY_CTE]), ("auc_roc", "auc_pr"))
def q_auc(spark, sf):
    """Exact areas of the anomaly score as a fraud score, over every transaction."""
    scored = M.anomaly_flags(fact_df(spark, sf)).select(
        F.col("is_fraud").cast("double").alias("is_fraud"),
        F.col("anomaly_score").cast("double").alias("rawPrediction"))
    m = ML.auc_metrics(scored)
    return spark.createDataFrame([(float(m["auc_roc"]), float(m["auc_pr"]))],
                                 "auc_roc double, auc_pr double")


RULE_SQL = with_base(
    ", p AS (SELECT is_fraud, CASE WHEN anomaly_score >= 3 THEN 1 ELSE 0 END AS prediction FROM b)\n"
    "{body}", extra=[ANOMALY_CTE])
CM_SQL = """SELECT count(*) FILTER (WHERE is_fraud = 1 AND prediction = 1) AS true_positives,
  count(*) FILTER (WHERE is_fraud = 0 AND prediction = 0) AS true_negatives,
  count(*) FILTER (WHERE is_fraud = 0 AND prediction = 1) AS false_positives,
  count(*) FILTER (WHERE is_fraud = 1 AND prediction = 0) AS false_negatives FROM p"""


def _rule_predictions(spark, sf):
    """A rule-based classifier: predict fraud when the anomaly score is >= 3."""
    return M.anomaly_flags(fact_df(spark, sf)).withColumn(
        "prediction", F.when(F.col("anomaly_score") >= 3, 1).otherwise(0))


@register("confusion_matrix", RULE_SQL.format(body=CM_SQL))
def q_confusion(spark, sf):
    return ML.confusion_matrix(_rule_predictions(spark, sf))


def _report_sql():
    d = lambda a, b: f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END"
    return f""", cm AS ({CM_SQL}),
c AS (SELECT *, true_positives::DOUBLE AS tp, true_negatives::DOUBLE AS tn,
  false_positives::DOUBLE AS fp, false_negatives::DOUBLE AS fn FROM cm),
m AS (SELECT *, {d('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
  {d('tp', 'tp + fp')} AS precision_fraud, {d('tp', 'tp + fn')} AS recall_fraud,
  {d('tn', 'tn + fn')} AS precision_normal, {d('tn', 'tn + fp')} AS recall_normal FROM c),
f AS (SELECT *, {d('2.0 * precision_fraud * recall_fraud', 'precision_fraud + recall_fraud')} AS f1_fraud,
  {d('2.0 * precision_normal * recall_normal', 'precision_normal + recall_normal')} AS f1_normal FROM m)
SELECT true_positives, true_negatives, false_positives, false_negatives, accuracy,
  precision_fraud, recall_fraud, precision_normal, recall_normal, f1_fraud, f1_normal,
  {d('precision_fraud * (tp + fn) + precision_normal * (tn + fp)', 'tp + fn + tn + fp')} AS precision_weighted,
  {d('recall_fraud * (tp + fn) + recall_normal * (tn + fp)', 'tp + fn + tn + fp')} AS recall_weighted,
  {d('f1_fraud * (tp + fn) + f1_normal * (tn + fp)', 'tp + fn + tn + fp')} AS f1_weighted,
  (recall_fraud + recall_normal) / 2.0 AS macro_recall FROM f"""


@register("classification_report", RULE_SQL.format(body=_report_sql()),
          ("accuracy", "precision_fraud", "recall_fraud", "precision_normal", "recall_normal",
           "f1_fraud", "f1_normal", "precision_weighted", "recall_weighted", "f1_weighted",
           "macro_recall"))
def q_report(spark, sf):
    return ML.classification_report(_rule_predictions(spark, sf))


@register("model_save", with_base(SPLIT_CTE + """SELECT txn_seq, true AS same FROM e
WHERE ts_seconds > (SELECT thr FROM t)"""))
def q_model_save(spark, sf):
    """Fit, persist, reload: the reloaded pipeline scores every test row as the first did."""
    df, train, test = _split(spark, sf)
    model = ML.train_lr(train, ML.available_features(df))
    again = ML.model_load(ML.model_save(model, scratch_path(spark, "model")))
    first, second = (ML.score_transactions(m, test).select("txn_seq", F.col(
        "fraud_probability").alias(n)) for m, n in ((model, "a"), (again, "b")))
    return first.join(second, "txn_seq").select("txn_seq", (F.col("a") == F.col("b")).alias("same"))


@register("run_log", with_base(SPLIT_CTE + f"""SELECT 'lr' AS model_type,
  count(*) FILTER (WHERE ts_seconds <= (SELECT thr FROM t)) AS train_rows,
  count(*) FILTER (WHERE ts_seconds > (SELECT thr FROM t)) AS test_rows, count(*) AS total_rows,
  CAST({len(_AVAILABLE)} AS INTEGER) AS n_features, CAST(2 AS INTEGER) AS n_metrics FROM e"""))
def q_run_log(spark, sf):
    """A training run's row in the log, read back."""
    df, train, test = _split(spark, sf)
    feats = ML.available_features(df)
    metrics = ML.auc_metrics(ML.score_transactions(ML.train_lr(train, feats), test))
    log = ML.run_log(spark, scratch_path(spark, "model_runs"), "lr_run",
                     {"model.type": "lr", "data.train_rows": train.count(),
                      "data.test_rows": test.count(), "data.total_rows": df.count()},
                     metrics, {"model_family": "spark_ml"}, feats)

    def param(name, kind):
        return F.get_json_object("params", f"$['{name}']").cast(kind)

    return log.select(param("model.type", "string").alias("model_type"),
                      *[param(f"data.{n}", "long").alias(n)
                        for n in ("train_rows", "test_rows", "total_rows")],
                      F.size("features").alias("n_features"), F.size("metrics").alias("n_metrics"))
