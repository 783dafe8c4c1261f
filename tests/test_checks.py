"""Data checks that must be able to fail."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from townrisk.plans import serve_queries as sq
from townrisk.plans.combine import combine
from townrisk.sources import staging


def test_rebuild_finds_a_planted_fault(spark):
    combine(spark, SF_SMALL)
    key = (spark.sparkContext.applicationId, "combine", SF_SMALL)
    right = staging._MEMO[key]
    wrong = right.withColumn("flood_score", F.when(F.col("zone") == 3, 1.25).otherwise(F.col("flood_score")))
    staging._MEMO[key] = wrong
    try:
        r = sq.q_rebuild_diff(spark, SF_SMALL).first()
        assert (r.only_staged, r.only_rebuilt) == (1, 1) and staging._MEMO[key] is wrong
    finally:
        staging._MEMO[key] = right


def test_set_equality_finds_a_missing_area(spark):
    from townrisk.plans.marts import mart_towns
    towns = mart_towns(spark, SF_SMALL)
    key = (spark.sparkContext.applicationId, "mart_towns", SF_SMALL)
    staging._MEMO[key] = towns.withColumn("has_polygon", F.when(F.col("key") == 5, 0).otherwise(F.col("has_polygon")))
    try:
        assert sq.q_dq_set_equality(spark, SF_SMALL).first().missing_in_index == 1
    finally:
        staging._MEMO[key] = towns


def test_differing_rows_are_found_by_digests(spark):
    from townrisk.operators.compare import differing_rows
    a = spark.range(20000).selectExpr("id as k", "cast(id % 7 as string) as v", "id / 3.0 as x")
    left, right, buckets = differing_rows(a, a.orderBy(F.rand(1)), ["k"])
    assert (left.count(), right.count(), buckets) == (0, 0, 0)
    b = a.withColumn("v", F.when(F.col("k") == 77, "z").otherwise(F.col("v"))).where("k <> 500").unionByName(a.where("k = 9"))
    left, right, buckets = differing_rows(a, b, ["k"])
    assert sorted(tuple(r)[:2] for r in left.collect()) == [(77, "0"), (500, "3")]
    assert sorted(tuple(r)[:2] for r in right.collect()) == [(9, "2"), (77, "z")]
    assert buckets == 3
    n = a.withColumn("v", F.when(F.col("k") == 5, F.lit(None).cast("string")).otherwise(F.col("v")))
    assert differing_rows(n, a, ["k"])[0].collect()[0].v is None
    e = a.limit(0)
    assert differing_rows(e, e, ["k"])[2] == 0 and differing_rows(a, e, ["k"])[0].count() == 20000


def test_equal_builds_shuffle_no_rows(spark):
    """What is exchanged are sums, already added up in the tasks."""
    from townrisk.operators import compare as C
    a = spark.range(1000).selectExpr("id as k", "id as v")
    plan = C._digests(a, F.pmod(F.xxhash64("k"), F.lit(C.COARSE)), 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("partial_sum") > plan.index("Exchange")
