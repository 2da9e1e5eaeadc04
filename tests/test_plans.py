"""The shape of physical plans: no nested loops, few exchanges, pruned and pushed-down scans."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries
from tests.conftest import SF_DIR

QUERIES = queries()
STREAMS = [n for n in QUERIES if n.startswith("stream_")]


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(STREAMS)))
def test_no_nested_loops_and_no_row_at_a_time_python(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


@pytest.mark.parametrize(
    "name",
    ["verify_shards", "redact", "redact_conversations", "normalise_sizes", "glob_filter",
     "classify_failures", "validate_config", "credential_key_scan", "suggest_key", "check_unknown_keys"],
)
def test_row_local_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize(
    "name,exchanges",
    [("content_dedup", 1), ("staleness", 1), ("throughput", 1), ("wide_counts_total", 1), ("report_retention", 1),
     ("latest_per_group", 1), ("top_failing", 1), ("baseline_asof", 3), ("verify_cursor", 3), ("overlapping_runs", 3)],
)
def test_exchanges_are_counted(spark, name, exchanges):
    """A carried window has three: two small ones for the seeds, one for the rows."""
    assert len(re.findall(r"Exchange hashpartitioning|Exchange SinglePartition", plan(spark, name))) <= exchanges


def test_policies_of_many_sources_stay_off_the_driver(spark):
    assert "Broadcast" not in plan(spark, "attach_policy")


def test_close_percentiles_come_from_one_digest(spark):
    text = plan(spark, "run_summary_cube")
    assert len(set(re.findall(r" percentile_approx\(duration_ms", text))) <= 1
    assert text.count("percentile_approx(") <= 4


def test_top_rows_are_limited_before_the_shuffle(spark):
    for name in ("report_retention", "retention_plan", "group_errors"):
        assert re.search(r"WindowGroupLimit .*Partial", plan(spark, name)), name
    assert "TakeOrderedAndProject" in plan(spark, "top_failing")


def test_scans_read_only_what_they_need(spark):
    assert re.search(r"ReadSchema: struct<doc_id:bigint>", plan(spark, "verify_shards"))
    text = plan(spark, "report_retention")
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_totalprice" not in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:" in plan(spark, "top_failing")
