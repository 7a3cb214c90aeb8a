"""What the physical plans must, and must not, look like."""

import pytest

from tidewarden.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
LAZY = [n for n in REGISTRY if not n.startswith(("stream_", "limit_rate", "doc_flatten"))]


def plan(spark, name):
    return REGISTRY[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_and_no_python(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


@pytest.mark.parametrize("name", ["samples_scan", "retention_age", "downsample_tiers", "precision_16", "shard_assign", "policy_violations"])
def test_row_wise_jobs_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_retention_reaches_the_scan(spark):
    assert "GreaterThanOrEqual(ts,2024-01-20" in plan(spark, "retention_age")


def test_rollup_reads_each_side_once_and_prunes(spark):
    text = plan(spark, "downsample_max")
    assert "GreaterThanOrEqual(ts,2024-01-30" in text and "LessThan(ts,2024-01-30" in text
    assert text.count("Exchange hashpartitioning") == 1 and "props" not in text


def test_part_assignment_moves_rows_once(spark):
    text = plan(spark, "part_assign")
    # Rows once; the other two move per-slice sums.
    assert text.count("Exchange hashpartitioning") == 3 and text.count("partial_sum") == 1
