"""Safety axis: crime counts per area -> smoothed rates -> percentile score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.ranking import pct_scores
from ..operators.smoothing import smooth_rate
from ..sources import testdata as T
from ..sources.staging import staged


def crime_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-area crime table (staged once per session)."""
    return staged(spark, "crime_wide", sf_dir, lambda: _crime_wide(spark, sf_dir))


def _crime_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas left-joined with the two years of counts; missing counts -> 0.

    The previous year is summed per key inside the same aggregate, so a
    duplicate key can never fan the join out.
    """
    a = T.areas(spark, sf_dir)
    inc = T.incidents_two_years(spark, sf_dir)
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return (a.join(inc, "key", "left")
            .select("key", "ward", "town", "pop", "zone",
                    z("serious_cur").alias("serious_cur"),
                    z("serious_prev").alias("serious_prev"),
                    (z("serious_cur") + z("serious_prev")).alias("serious"),
                    z("daily_cur").alias("daily"),
                    z("visitor_cur").alias("visitor"),
                    z("total_cur").alias("total")))


def safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-area safety table (staged once per session)."""
    return staged(spark, "safety", sf_dir, lambda: _safety(spark, sf_dir))


def _safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, ward, town, pop, zone, counts, rates, group scores, safety_score."""
    # starts from the staged per-area table, so the ranks need no further lineage cut
    return scored(crime_wide(spark, sf_dir))


def scored(m: DataFrame) -> DataFrame:
    """Adds rates, group scores and safety_score to a written table with pop and the groups' counts."""
    valid = F.col("pop") >= K.MIN_POP
    for g in ("serious", "daily"):
        m = smooth_rate(m, g, "pop", K.SAFETY_YEARS[g], f"{g}_rate",
                        prior=K.PRIOR_EVENTS, valid=valid)
    m = pct_scores(m, [(f"{g}_rate", f"{g}_score", None) for g in ("serious", "daily")])
    total = None
    for g, w in K.SAFETY_WEIGHTS.items():
        term = F.col(f"{g}_score") * F.lit(w)
        total = term if total is None else total + term
    return m.withColumn("safety_score", total)


def visitor_rate(m: DataFrame) -> DataFrame:
    """Visitor-type incidents per 1000 residents, gated by population."""
    return m.withColumn(
        "visitor_rate",
        F.when(F.col("pop") >= K.MIN_POP,
               F.try_divide(F.col("visitor").cast("double"), F.col("pop")) * 1000.0))
