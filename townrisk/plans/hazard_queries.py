"""Queries over hazards x zones."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import hazards as H
from .common import round_doubles
from .zones import hazard_polys, zone_polys


def q_poly_intersects(spark: SparkSession, d: str) -> DataFrame:
    return H.zone_hazard_pairs(spark, d)


def q_semi_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = H.candidate_zones(spark, d).select("zone", "ward")
    flag = H.zone_hazard_pairs(spark, d).select("zone").distinct() \
        .withColumn("hit", F.lit(True))
    return c.join(flag, "zone", "left").select(
        "zone", "ward", F.coalesce(F.col("hit"), F.lit(False)).alias("intersects"))


def q_overlay_area(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(H.zone_hazard_overlay(spark, d))


def q_overlay_chunks(spark: SparkSession, d: str) -> DataFrame:
    """B5: the overlay areas by a resumable build in the shared folder."""
    folder = hashlib.sha256(d.encode()).hexdigest()[:16]
    return round_doubles(H.chunked_overlay(spark, d, f"{shared_folder(spark)}/builds/overlay-{folder}"))


def q_union_area(spark: SparkSession, d: str) -> DataFrame:
    h = hazard_polys(spark, d)
    u = H.union_ratio(spark, d, h)
    return round_doubles(u.withColumnsRenamed({"area": "hazard_area", "ratio": "hazard_ratio"}))


def q_collapse_ratio(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(H.collapse_by_zone(spark, d))


def q_national_rivers(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(H.national_by_zone(spark, d))


def q_weighted_exposure(spark: SparkSession, d: str) -> DataFrame:
    ov = H.zone_hazard_overlay(spark, d)
    h = hazard_polys(spark, d).select("poly_id", "river", "rk")
    dt = F.broadcast(H.depth_table(spark))
    za = zone_polys(spark, d).select("zone", "zone_area")
    r = (ov.join(h, "poly_id").join(dt, "rk")
         .groupBy("zone", "river").agg(F.sum(F.col("metres") * F.col("a")).alias("da"),
                                       F.sum("a").alias("river_area"))
         .join(za, "zone")
         .select("zone", H.river_name(F.col("river")).alias("river"), "river_area",
                 (F.col("da") / F.col("zone_area")).alias("exposure")))
    return round_doubles(r)


def q_distinct_list(spark: SparkSession, d: str) -> DataFrame:
    return H.national_by_zone(spark, d).select("zone", "nat_rivers")


def q_code_lookup(spark: SparkSession, d: str) -> DataFrame:
    h = hazard_polys(spark, d).select("poly_id", "rk")
    dt = F.broadcast(H.depth_table(spark))
    return h.join(dt, "rk", "left").select("poly_id", "rk", F.col("label").alias("depth_label"),
                                           F.col("metres").alias("depth_m"))
