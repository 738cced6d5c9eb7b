"""Plan shapes: no all-pairs joins, pruned reads, pushed filters, few Python nodes."""

import re

import pytest

from tideline.plans import ORACLES, QUERIES

FITS = {"oof_keys"}
PYTHON = {"call_budget", "budget_report", "budget_by_key"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(ORACLES) - FITS))
def test_no_query_pairs_all_rows_or_leaves_the_jvm(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert not re.search(r"(Python|InPandas|InArrow)", plan)


def test_reads_are_pruned_and_filters_pushed(spark, sf_dir):
    plan = plan_of(QUERIES["ratio_feature"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    plan = plan_of(QUERIES["linear_score"](spark, sf_dir))
    assert "EqualTo(o_orderstatus,F)" in plan and "LessThan(o_orderdate" in plan
    assert "c_name" not in plan and "o_orderpriority" not in plan


@pytest.mark.parametrize("name", ["clean_profile", "top_drivers", "compose_answer", "label_at_threshold"])
def test_cleaning_and_scoring_add_no_shuffle(spark, sf_dir, name):
    """Only the view itself aggregates orders and joins them to customers."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    allowed = 2 + (name == "label_at_threshold")  # plus its own group-by
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) <= allowed


def test_requests_redaction_and_text_are_narrow(spark, sf_dir):
    for name in ("validate_request", "read_turns", "redact_documents", "normalize_text", "canon_value"):
        assert "Exchange" not in plan_of(QUERIES[name](spark, sf_dir)), name
