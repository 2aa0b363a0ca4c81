"""Write PLANS.md: physical-plan shape (after AQE) of every registered query.

    python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TAGS = [("Exchange", "exchanges"), ("Sort [", "sorts"), ("Window [", "windows"),
        ("HashAggregate(", "hash aggs"), ("SortAggregate(", "sort aggs"),
        ("SortMergeJoin", "SMJ"), ("BroadcastHashJoin", "BHJ"), ("Scan ", "scans")]


def shape(df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    return [plan.count(t) for t, _ in TAGS]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from txnlake.plans import registry
    from txnlake.session import build_session
    registry.load_all()
    spark = build_session("local[8]")
    lines = ["# PLANS", "",
             f"Physical plan shape after adaptive execution, per registered query, at `{sf}`",
             "(counts of operators in the final plan; IO keys show their last read).", "",
             "| query | " + " | ".join(n for _, n in TAGS) + " |",
             "|---|" + "---|" * len(TAGS)]
    for name in sorted(registry.RAW):
        if name in {"tune_cv", "train_rf", "train_gbt", "train_lr", "auc_metrics", "run_log",
                    "model_save", "score_transactions", "assemble_scale", "hourly_stream_clean"}:
            continue
        try:
            counts = shape(registry.RAW[name](spark, sf))
        except Exception as e:  # noqa: BLE001
            print(name, e)
            continue
        lines.append(f"| `{name}` | " + " | ".join(str(c) for c in counts) + " |")
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print("wrote", out)
    spark.stop()


if __name__ == "__main__":
    main()
