"""Combined per-zone table: four parallel axes, their gates and evidence.

The axes are never merged into one number.  "No data" stays NULL with a
coverage flag; it is never 0 or 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.ranking import pct_scores, quantiles, rank_low_pct
from ..operators.sizing import cut_lineage
from ..operators.smoothing import smooth_rate
from ..sources.staging import staged
from .hazards import collapse_by_zone, national_by_zone
from .safety import crime_wide
from .zones import flood_by_zone, ground_by_zone, history_flags, tide_by_zone, zone_polys


def safety_by_zone(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "safety_by_zone", d, lambda: _safety_by_zone(spark, d))


def _safety_by_zone(spark: SparkSession, d: str) -> DataFrame:
    """Area counts summed per zone, then smoothed and ranked across zones."""
    c = crime_wide(spark, d).groupBy("zone").agg(
        F.sum("pop").alias("pop"), F.sum("serious").alias("serious"),
        F.sum("serious_cur").alias("serious_cur"), F.sum("daily").alias("daily"),
        F.sum("visitor").alias("visitor"), F.sum("total").alias("total"))
    valid = F.col("pop") >= K.MIN_POP
    for g in ("serious", "daily"):
        c = smooth_rate(c, g, "pop", K.SAFETY_YEARS[g], f"{g}_rate",
                        prior=K.PRIOR_EVENTS, valid=valid)
    c = cut_lineage(c)
    c = pct_scores(c, [(f"{g}_rate", f"{g}_score", None) for g in ("serious", "daily")])
    total = None
    for g, w in K.SAFETY_WEIGHTS.items():
        term = F.col(f"{g}_score") * F.lit(w)
        total = term if total is None else total + term
    c = c.withColumn("safety_score", total)
    c = c.withColumn("visitor_rate", F.when(valid, F.try_divide(
        F.col("visitor").cast("double"), F.col("pop")) * 1000.0))
    thr = quantiles(c, "visitor_rate", [K.BUSINESS_QUANTILE], ["_thr"]).scalar()
    return c.withColumn("business_area_flag",
                        F.coalesce(F.col("visitor_rate") >= thr, F.lit(False)))


def combine(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "combine", d, lambda: _combine(spark, d))


def _combine(spark: SparkSession, d: str) -> DataFrame:
    """One row per zone with every axis, gate, score and flag."""
    z = zone_polys(spark, d).select("zone", "ward", "name", "region", "zone_area")
    s = safety_by_zone(spark, d)
    fl = flood_by_zone(spark, d)
    td = tide_by_zone(spark, d).drop("region")
    gr = ground_by_zone(spark, d)
    hi = history_flags(spark, d)
    na = national_by_zone(spark, d)
    co = collapse_by_zone(spark, d)
    m = (z.join(s, "zone", "left").join(fl, "zone", "left").join(td, "zone", "left")
         .join(gr, "zone", "left").join(hi, "zone", "left").join(na, "zone", "left")
         .join(co, "zone", "left"))
    # Measures that are ranked or compared are rounded to 1e-9 first: values
    # that are equal in exact arithmetic must tie instead of being ordered
    # by floating-point noise of sums taken in task order.
    m = m.withColumn("nat_exposure", F.round(F.coalesce(F.col("nat_exposure"), F.lit(0.0)), 9))
    pop_ok = F.coalesce(F.col("pop") >= K.MIN_POP, F.lit(False))
    tokyo = F.round(F.coalesce(F.col("tk_flood_ratio") * F.col("tk_mean_depth"), F.lit(0.0)), 9)
    nat = F.col("nat_exposure")
    fb = lambda c: F.coalesce(F.col(c), F.lit(False))
    m = m.select(
        "*",
        pop_ok.alias("pop_ok"),
        (pop_ok & fb("tk_coverage")).alias("flood_valid"),
        tokyo.alias("tokyo_exposure"),
        F.greatest(tokyo, nat).alias("flood_exposure"),
        F.when(nat > tokyo, F.lit(K.FLOOD_SOURCE_NATIONAL))
        .otherwise(F.lit(K.FLOOD_SOURCE_CITY)).alias("flood_source"),
        F.round(F.coalesce(F.col("ts_exposure"), F.lit(0.0)), 9).alias("tide_exposure"),
        F.round(F.col("liq_pl"), 9).alias("_liq_pl_r"),
        F.round(F.col("tk_mean_elev"), 9).alias("_elev_r"),
        (pop_ok & fb("liq_covered")).alias("liq_valid"),
        fb("tk_below_sea").alias("below_sea_flag"),
        F.col("nat_ratio").isNotNull().alias("nat_covered"),
        (~F.col("region").isin(*K.FIXTURE_TIDE_OUT_REGIONS)).alias("tide_in_scope"),
    )
    # one row per zone: cheap to checkpoint; the ranks below reuse it
    m = cut_lineage(m)
    m = pct_scores(m, [("flood_exposure", "flood_score", F.col("flood_valid")),
                       ("tide_exposure", "tide_score", F.col("pop_ok")),
                       ("_liq_pl_r", "ground_score", F.col("liq_valid"))])
    m = rank_low_pct(m, "_elev_r", "elev_score", valid=F.col("flood_valid"))
    return m.withColumn("scored", F.col("safety_score").isNotNull()).drop("_liq_pl_r", "_elev_r")
