"""Every registered query against its SQL, and the shape of the plans."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_answer_and_plan(spark, con, name):
    """Rows equal to the SQL; no pairing joins, row-at-a-time Python or window over everything."""
    frame = QUERIES[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan)
    assert not re.search(r"Window \[[^\]]*\], \[\]", plan)
    ok, message, _, _ = compare(spark, SF, lambda *_: frame, SQL.get(name), con)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["page_links"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    plan = QUERIES["bytes_processed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<html:string>" in plan


def test_previews_cut_before_the_shuffle(spark):
    plan = QUERIES["preview_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
