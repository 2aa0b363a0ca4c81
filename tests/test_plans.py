"""Plan guards: no cross joins anywhere, and no Python UDFs in the registered plans."""

import pytest

from txnlake.plans import registry

from .conftest import SF001

SKIP_PREFIX = ("train_", "tune_", "auc_", "model_", "run_log", "score_", "assemble_",
               "hourly_stream")
IO_WITHOUT_HOURS = {"upsert_by_key", "latest_version_per_key", "retention_filter", "default_now",
                    "dq_unique", "dq_not_null", "dq_freshness", "dq_profile", "csv_step_ingest",
                    "bad_row_tolerance", "materialize_view", "materialize_table"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def _names():
    """Keys whose plans are built without writing hour partitions or fitting models (those
    are covered by tools/oracle_check.py)."""
    registry.load_all()
    return [n for n in sorted(registry.RAW) if not n.startswith(SKIP_PREFIX)
            and (registry.SOURCE_FUNCS[n].__module__ != "txnlake.plans.queries_io"
                 or n in IO_WITHOUT_HOURS)]


@pytest.mark.parametrize("name", _names())
def test_plan_has_no_cross_join_or_python(spark, name):
    df = registry.RAW[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [t for t in FORBIDDEN if t in plan]
    assert not bad, f"{name}: {bad}"
