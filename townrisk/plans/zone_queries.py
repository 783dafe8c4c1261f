"""Queries over points / borings / hazards joined to zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.ranking import rank_low_pct, top1
from ..sources import testdata as T
from . import zones as Z
from .common import round_doubles


def q_pip_count(spark: SparkSession, d: str) -> DataFrame:
    j = Z.points_in_zones(spark, d)
    return j.groupBy("zone").agg(F.count(F.lit(1)).alias("n_points"))


def q_zone_depth_stats(spark: SparkSession, d: str) -> DataFrame:
    st = Z.zone_stats(Z.zone_basin_table(spark, d))
    return round_doubles(st.select("zone", F.col("n").cast("long").alias("n"),
                                   F.col("n_flood").cast("long").alias("n_flood"),
                                   "depth_sum", "depth_max", "elev_sum", "elev_min"))


def q_flood_by_zone(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(Z.flood_by_zone(spark, d))


def q_top1_per_group(spark: SparkSession, d: str) -> DataFrame:
    zb = Z.zone_basin_table(spark, d).where(F.col("n_flood") > 0)
    t = top1(zb, ["zone"], "n_flood", "basin", ["basin", "n_flood"], prefix="main_")
    return t.select("zone", "main_basin", F.col("main_n_flood").cast("long").alias("main_n_flood"))


def q_ordered_list(spark: SparkSession, d: str) -> DataFrame:
    return Z.basin_list(Z.zone_basin_table(spark, d))


def other_basins(df: DataFrame, lst: str = "tk_basins", main: str = "tk_main_basin") -> DataFrame:
    """Split the '|' list, drop empty items and the main basin."""
    parts = F.filter(F.split(F.coalesce(F.col(lst), F.lit("")), r"\|"),
                     lambda b: (b != "") & (b != F.coalesce(F.col(main), F.lit(""))))
    return df.withColumn("_o", parts).withColumn(
        "other_basins", F.array_join("_o", K.RIVER_LIST_SEPARATOR)) \
        .withColumn("n_other", F.size("_o").cast("long")).drop("_o")


def q_other_basins(spark: SparkSession, d: str) -> DataFrame:
    f = other_basins(Z.flood_by_zone(spark, d))
    return f.select("zone", "other_basins", "n_other")


def q_elev_score(spark: SparkSession, d: str) -> DataFrame:
    f = Z.flood_by_zone(spark, d)
    f = rank_low_pct(f, "tk_mean_elev", "elev_score", valid=F.col("tk_coverage"))
    return round_doubles(f.select("zone", "tk_mean_elev", "elev_score"))


def zone_population(spark: SparkSession, d: str) -> DataFrame:
    """Residents per zone (areas summed by their nation)."""
    return T.areas(spark, d).groupBy("zone").agg(F.sum("pop").alias("pop"))


def q_coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    f = Z.flood_by_zone(spark, d).join(zone_population(spark, d), "zone", "left")
    r = f.agg(F.count(F.lit(1)).alias("n_zones"),
              F.count_if("tk_coverage").alias("n_covered"),
              F.count_if("tk_below_sea").alias("n_below_sea"),
              F.sum(F.when(F.col("tk_below_sea"), F.col("pop")).otherwise(F.lit(0.0)))
              .alias("pop_below_sea"),
              F.sum("pop").alias("pop_total"))
    return round_doubles(r.withColumn("share_covered", F.col("n_covered") / F.col("n_zones")))


def basin_label(slug_col) -> "F.Column":
    """Official label of a basin slug; an unknown slug stands for itself."""
    m = F.create_map(*[F.lit(x) for kv in K.BASIN_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(m, slug_col), slug_col)


def q_basin_label(spark: SparkSession, d: str) -> DataFrame:
    p = T.points(spark, d)
    g = p.groupBy("basin").agg(F.count(F.lit(1)).alias("n_points"),
                               F.count_if(F.col("depth") > 0).alias("n_flood"))
    return g.select("basin", basin_label(F.lower(F.col("basin"))).alias("basin_label"),
                    "n_points", "n_flood")


def q_tide_exposure(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(Z.tide_by_zone(spark, d).drop("region"))


def q_class_counts(spark: SparkSession, d: str) -> DataFrame:
    c = Z.class_counts(Z.borings_in_zones(spark, d))
    return round_doubles(c.select("zone", F.col("liq_points").cast("long").alias("liq_points"),
                                  "liq_sum", F.col("liq_small").cast("long").alias("liq_small"),
                                  F.col("liq_mid").cast("long").alias("liq_mid"),
                                  F.col("liq_large").cast("long").alias("liq_large")))


def q_ground_pl(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(Z.ground_by_zone(spark, d))


def q_unknown_codes(spark: SparkSession, d: str) -> DataFrame:
    b = T.borings(spark, d)
    w = Z.pl_weights(spark)
    g = b.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(w), "cls", "left").select(
        "cls", F.col("w").isNotNull().alias("known"), "n")


def q_history_flags(spark: SparkSession, d: str) -> DataFrame:
    return Z.history_flags(spark, d)
