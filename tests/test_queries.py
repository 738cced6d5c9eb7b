"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare
from tideline.plans import ORACLES, QUERIES

SLOW = {"train_protocol", "train_summary", "search_params", "bundle_roundtrip", "churn_report"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    message, rows = compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name])
    assert message == ""
    assert rows > 0 or name == "budget_report"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_entry_is_the_churn_report(spark):
    report = entry.entry(spark)
    assert report.columns == ["customerID", "score", "calibrated", "label", "drivers"]
    rows = report.collect()
    assert len(rows) == len({r["customerID"] for r in rows}) > 0
    assert all(len(r["drivers"].split(",")) == 3 for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
