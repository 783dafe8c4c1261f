"""Queries over the areas + incidents inputs (safety axis and friends)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.ranking import pct_score, quantiles
from ..operators.smoothing import smooth_rate
from ..sources import testdata as T
from .common import round_doubles
from .safety import crime_wide, safety, visitor_rate


def q_safety_score(spark: SparkSession, d: str) -> DataFrame:
    s = safety(spark, d)
    return round_doubles(s.select("key", "ward", "town", "pop", "serious", "daily",
                                  "serious_rate", "daily_rate", "serious_score",
                                  "daily_score", "safety_score"))


def q_left_join_fill(spark: SparkSession, d: str) -> DataFrame:
    a = T.areas(spark, d)
    inc = T.incidents(spark, d, K.CURRENT_YEAR).drop("yr")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return round_doubles(a.join(inc, "key", "left")
                         .select("key", "ward", "town", "pop",
                                 z("serious"), z("daily"), z("visitor"), z("total")))


CHAIN_YEARS = (2000, 1999, 1998, 1997)


def q_wide_left_chain(spark: SparkSession, d: str) -> DataFrame:
    """The four yearly left joins of the wide table, as ONE pivoting
    aggregate (one shuffle of orders) plus one left join to the areas."""
    o = (T.table(spark, d, "orders")
         .where((F.col("o_orderdate") >= T.ts_ntz(f"{min(CHAIN_YEARS)}-01-01 00:00:00"))
                & (F.col("o_orderdate") < T.ts_ntz(f"{max(CHAIN_YEARS) + 1}-01-01 00:00:00"))))
    yr = F.year("o_orderdate")
    wide = o.groupBy(F.col("o_custkey").alias("key")).agg(
        *[F.count_if((yr == y) & T.SERIOUS()).cast("long").alias(f"serious_{y}")
          for y in CHAIN_YEARS],
        F.count(F.lit(1)).cast("long").alias("total_4y"))
    cols = [f"serious_{y}" for y in CHAIN_YEARS] + ["total_4y"]
    a = T.areas(spark, d).select("key", "ward", "pop")
    return round_doubles(a.join(wide, "key", "left").select(
        "key", "ward", "pop",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in cols]))


def q_smooth_rate(spark: SparkSession, d: str) -> DataFrame:
    m = crime_wide(spark, d)
    m = smooth_rate(m, "serious", "pop", K.SAFETY_YEARS["serious"], "serious_rate",
                    prior=K.PRIOR_EVENTS, valid=F.col("pop") >= K.MIN_POP)
    return round_doubles(m.select("key", "pop", "serious", "serious_rate"))


def q_pct_score(spark: SparkSession, d: str) -> DataFrame:
    """Percentile score of a heavily tied integer measure."""
    m = crime_wide(spark, d)
    m = pct_score(m, "serious", "serious_pct", valid=F.col("pop") >= K.MIN_POP)
    return round_doubles(m.select("key", "serious", "serious_pct"))


def q_topk_safety(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    s = safety(spark, d)
    top = (s.where(F.col("safety_score").isNotNull())
           .orderBy(F.desc("safety_score"), F.asc("key")).limit(k))
    return round_doubles(top.select("key", "ward", "town", "safety_score"))


def business_flag(m: DataFrame) -> DataFrame:
    m = visitor_rate(m)
    thr = quantiles(m, "visitor_rate", [K.BUSINESS_QUANTILE], ["_thr"]).scalar()
    return m.withColumn("business_area_flag",
                        F.coalesce(F.col("visitor_rate") >= thr, F.lit(False)))


def q_business_flag(spark: SparkSession, d: str) -> DataFrame:
    m = business_flag(crime_wide(spark, d))
    return round_doubles(m.select("key", "visitor_rate", "business_area_flag"))


def q_median_by_count(spark: SparkSession, d: str) -> DataFrame:
    s = safety(spark, d).where(F.col("safety_score").isNotNull())
    med = quantiles(s, "safety_score", [0.5], ["median_score"], by=["serious"],
                    count_name="n_areas")
    return round_doubles(med)


def q_unmatched(spark: SparkSession, d: str) -> DataFrame:
    a = T.areas(spark, d)
    inc = T.incidents(spark, d, K.CURRENT_YEAR).select("key")
    return round_doubles(a.join(inc, "key", "left_anti").select("key", "ward", "town", "pop"))


def q_mart_crime(spark: SparkSession, d: str) -> DataFrame:
    m = crime_wide(spark, d)
    return m.select("key", F.lit(K.DATA_YEAR).alias("data_year"),
                    F.col("serious").alias("serious_2y"),
                    F.col("serious_cur").alias("serious_r"),
                    F.col("daily").alias("daily_r"), "visitor", "total")


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, 25/50/75 % (exact, interpolated), max and the
    number of distinct values (at 1e-9)."""
    base = df.where(F.col(value).isNotNull())
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                     F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
                     F.max(value).alias("max"),
                     F.count_distinct(F.round(value, 9)).alias("n_unique"))
    q = quantiles(base, value, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    return stats.select("n", "mean", "std", "min",
                        *[q.select(c).scalar().alias(c) for c in ("p25", "p50", "p75")],
                        "max", "n_unique")


def q_describe(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(describe(safety(spark, d), "safety_score"))


def q_match_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of areas that found their current-year incident row (M1)."""
    a = T.areas(spark, d).select("key")
    inc = T.incidents(spark, d, K.CURRENT_YEAR) \
        .select("key", F.lit(True).alias("_hit"))
    j = a.join(inc, "key", "left")
    r = j.agg(F.count(F.lit(1)).alias("n_areas"), F.count_if(F.col("_hit").isNotNull()).alias("n_matched"))
    return round_doubles(r.withColumn("match_rate", F.col("n_matched") / F.col("n_areas")))


def q_top_wards(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    """Group counts in descending order, first k (G4): scored areas per ward."""
    a = T.areas(spark, d).where(F.col("pop") >= K.MIN_POP)
    g = a.groupBy("ward").agg(F.count(F.lit(1)).alias("n_areas"))
    return g.orderBy(F.desc("n_areas"), "ward").limit(k)
