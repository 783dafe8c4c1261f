"""Physical plan checks: the hot paths stay JVM-side and never pull a big
input into one partition."""

from conftest import SF_SMALL
from townrisk.plans import crime_queries as cq
from townrisk.plans import zone_queries as zq


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_point_join_is_broadcast_and_python_free(spark):
    p = plan_text(zq.q_pip_count(spark, SF_SMALL))
    assert "BroadcastHashJoin" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p


def test_safety_scan_pushdown_and_pruning(spark):
    from townrisk.plans.safety import _crime_wide as crime_wide
    txt = plan_text(cq.q_safety_score(spark, SF_SMALL))
    assert "PythonUDF" not in txt and "ArrowEvalPython" not in txt
    # the ranks start from a checkpoint; the scans live in the plan before it
    scan = plan_text(crime_wide(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in scan


def test_orders_scan_reads_only_needed_columns(spark):
    from townrisk.sources.testdata import incidents_two_years
    txt = plan_text(incidents_two_years(spark, SF_SMALL))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in txt
    assert "GreaterThanOrEqual(o_orderdate" in txt


def test_no_cartesian_or_nested_loop_joins(spark):
    from townrisk.plans import hazard_queries as hq
    for df in (cq.q_safety_score(spark, SF_SMALL), cq.q_business_flag(spark, SF_SMALL),
               zq.q_ground_pl(spark, SF_SMALL), hq.q_overlay_area(spark, SF_SMALL)):
        txt = plan_text(df)
        assert "CartesianProduct" not in txt and "BroadcastNestedLoopJoin" not in txt


def test_wide_chain_scans_orders_once(spark):
    txt = plan_text(cq.q_wide_left_chain(spark, SF_SMALL))
    # one scan each of customer, nation and orders: the four yearly joins
    # are a single pivoting aggregate over one orders scan
    assert txt.count("orders.parquet") == 1
    assert txt.count("FileScan parquet") == 3


def test_year_reaches_the_scan(spark):
    for df in (cq.q_left_join_fill(spark, SF_SMALL), cq.q_unmatched(spark, SF_SMALL), cq.q_match_rate(spark, SF_SMALL)):
        assert "GreaterThanOrEqual(o_orderdate" in plan_text(df)
