"""Served marts (one row per zone and data year) built from the combined table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo as G
from ..sources.staging import staged
from .combine import combine
from .safety import crime_wide

# Fixture geometry is in kilometres of plane zone IX.
FIXTURE_UNIT_M = 1000.0


def ward_codes(spark: SparkSession, d: str) -> DataFrame:
    """ward -> ward_code from the region table ('W' + zero padded key)."""
    r = spark.read.parquet(f"{d.rstrip('/')}/region.parquet")
    return r.select(F.col("r_name").alias("ward"),
                    F.concat(F.lit("W"), F.lpad(F.col("r_regionkey").cast("string"), 2, "0"))
                    .alias("ward_code"))


def mart_towns(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "mart_towns", d, lambda: _mart_towns(spark, d), cluster_by=["key"])


def _mart_towns(spark: SparkSession, d: str) -> DataFrame:
    m = combine(spark, d).select("zone", "ward", "name", "pop")
    from .geo_queries import polygons, resolve, shared_polygon_keys
    # the area's polygon by its alias, as every other consumer resolves it
    z = resolve(spark, d).select(F.col("key").alias("zone"), "poly_key").join(polygons(spark, d), "poly_key")
    cx, cy = G.centroid("rings")
    geo = z.select("zone", (cx * F.lit(FIXTURE_UNIT_M)).alias("_cx"),
                   (cy * F.lit(FIXTURE_UNIT_M)).alias("_cy"),
                   (F.col("zone_area") * F.lit(FIXTURE_UNIT_M ** 2)).alias("area_m2"))
    geo = G.with_lonlat_zone9(geo, "_cx", "_cy", "lng", "lat").drop("_cx", "_cy")
    shared = shared_polygon_keys(spark, d).withColumnRenamed("key", "zone")
    return (m.join(geo, "zone", "left").join(ward_codes(spark, d), "ward", "left")
            .join(shared, "zone", "left")
            .select(F.col("zone").alias("key"), "ward", F.col("name").alias("town"), "ward_code",
                    "lat", "lng", "area_m2", F.col("pop").alias("population"),
                    F.col("lat").isNotNull().cast("int").alias("has_polygon"), "shared_polygon_key"))


def mart_scores(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "mart_scores", d, lambda: _mart_scores(spark, d),
                  partition_by=["data_year"], cluster_by=["key"])


def _mart_scores(spark: SparkSession, d: str) -> DataFrame:
    m = combine(spark, d)
    return m.select(
        F.col("zone").alias("key"), F.lit(K.DATA_YEAR).alias("data_year"),
        "safety_score", "flood_score", "tide_score", "ground_score",
        "serious_score", "daily_score", "flood_exposure", "tide_exposure", "elev_score",
        F.col("tk_mean_elev").alias("mean_elev_m"),
        F.col("below_sea_flag").cast("int").alias("below_sea"),
        F.col("business_area_flag").cast("int").alias("business_area"),
        F.col("scored").cast("int").alias("scored"))


def mart_hazard(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "mart_hazard", d, lambda: _mart_hazard(spark, d),
                  partition_by=["data_year"], cluster_by=["key"])


def _mart_hazard(spark: SparkSession, d: str) -> DataFrame:
    m = combine(spark, d)
    i = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    f0 = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return m.select(
        F.col("zone").alias("key"), F.lit(K.DATA_YEAR).alias("data_year"),
        F.col("tk_flood_ratio").alias("flood_ratio"),
        F.col("tk_mean_depth").alias("flood_mean_depth"),
        F.col("tk_max_depth").alias("flood_max_depth"),
        i("tk_coverage").alias("flood_covered"),
        F.col("tk_main_basin").alias("flood_basin"),
        F.col("tk_main_basin_ratio").alias("flood_basin_ratio"),
        F.col("tk_basins").alias("flood_basins"),
        f0("ts_flood_ratio").alias("tide_ratio"), f0("ts_mean_depth").alias("tide_mean_depth"),
        f0("ts_max_depth").alias("tide_max_depth"),
        F.col("tide_in_scope").cast("int").alias("tide_in_scope"),
        F.col("tk_mean_elev").alias("mean_elev_m"), F.col("tk_min_elev").alias("min_elev_m"),
        z("liq_points").alias("liq_points"), z("liq_small").alias("liq_small"),
        z("liq_mid").alias("liq_mid"), z("liq_large").alias("liq_large"), "liq_pl",
        i("liq_covered").alias("liq_covered"), i("liq_thin").alias("liq_thin"),
        i("liq_history").alias("liq_history"), i("liq_1923").alias("liq_1923"),
        i("liq_2011").alias("liq_2011"),
        i("collapse_zone").alias("collapse_zone"),
        f0("collapse_flow_ratio").alias("collapse_flow_ratio"),
        f0("collapse_erosion_ratio").alias("collapse_erosion_ratio"),
        i("nat_covered").alias("national_river"), "nat_rivers", "nat_ratio",
        f0("nat_exposure").alias("nat_exposure"), "nat_main_label", "nat_main_ratio",
        "nat_max_label", "nat_max_ratio", "flood_source", "tokyo_exposure")


def mart_zone_crime(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "mart_zone_crime", d, lambda: _mart_zone_crime(spark, d),
                  partition_by=["data_year"], cluster_by=["key"])


def _mart_zone_crime(spark: SparkSession, d: str) -> DataFrame:
    """The per-area crime counts summed up to the served keys."""
    m = crime_wide(spark, d)
    return (m.groupBy(F.col("zone").alias("key")).agg(
        F.sum("serious").alias("serious_2y"), F.sum("serious_cur").alias("serious_r"),
        F.sum("daily").alias("daily_r"), F.sum("total").alias("total_r"))
        .withColumn("data_year", F.lit(K.DATA_YEAR)))
