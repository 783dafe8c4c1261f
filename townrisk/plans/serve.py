"""Serving queries over the marts: list, detail, status, evidence, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .marts import mart_hazard, mart_scores, mart_towns, mart_zone_crime

AXES = ("safety", "flood", "tide", "ground")


def index(spark: SparkSession, d: str, year: int = K.DATA_YEAR) -> DataFrame:
    """towns x scores x hazard for one data year, ordered by ward, town.

    The year predicate is applied on both served tables, so with marts
    partitioned by ``data_year`` it prunes partitions at the scan.
    """
    t = mart_towns(spark, d)
    s = mart_scores(spark, d).where(F.col("data_year") == year)
    h = mart_hazard(spark, d).where(F.col("data_year") == year)
    return (t.join(s.select("key", "safety_score", "flood_score", "tide_score", "ground_score",
                            "scored"), "key")
            .join(h.select("key", "flood_covered", "tide_in_scope", "liq_covered"), "key"))


def masked(df: DataFrame) -> DataFrame:
    """An axis score is shown only where that axis was measured."""
    return df.select(
        "key", "ward", "town", F.col("population").alias("pop"),
        F.col("safety_score").alias("s"),
        F.when(F.col("flood_covered") == 1, F.col("flood_score")).alias("f"),
        F.when(F.col("tide_in_scope") == 1, F.col("tide_score")).alias("t"),
        F.when(F.col("liq_covered") == 1, F.col("ground_score")).alias("g"),
        (F.col("scored") == 1).alias("scored"), (F.col("tide_in_scope") == 1).alias("tide_scope"),
        "lat", "lng")


def detail(spark: SparkSession, d: str, key=None, year: int = K.DATA_YEAR) -> DataFrame:
    """4-way join of the served tables for one key or for all keys.

    The marts are laid out by key, so the filter on one key, which reaches
    every scan, reads the row groups that hold it.
    """
    t = mart_towns(spark, d)
    parts = [m(spark, d).where(F.col("data_year") == year).drop("data_year")
             for m in (mart_scores, mart_zone_crime, mart_hazard)]
    if key is not None:
        t, *parts = (m.where(F.col("key") == F.lit(key)) for m in (t, *parts))
    for m in parts:
        t = t.join(m, "key")
    return t


def axis_status(df: DataFrame) -> DataFrame:
    """(key, axis, status, score): not_scored > no_data / out_of_scope > scored."""
    ns = F.col("scored") == 0
    st_f = F.when(ns, "not_scored").when(F.col("flood_covered") == 0, "no_data").otherwise("scored")
    st_t = F.when(ns, "not_scored").when(F.col("tide_in_scope") == 0, "out_of_scope") \
        .otherwise("scored")
    st_g = F.when(ns, "not_scored").when(F.col("liq_covered") == 0, "no_data").otherwise("scored")
    st_s = F.when(ns, "not_scored").otherwise("scored")
    rows = F.array(
        F.struct(F.lit("safety").alias("axis"), st_s.alias("status"), F.col("safety_score").alias("v")),
        F.struct(F.lit("flood").alias("axis"), st_f.alias("status"), F.col("flood_score").alias("v")),
        F.struct(F.lit("tide").alias("axis"), st_t.alias("status"), F.col("tide_score").alias("v")),
        F.struct(F.lit("ground").alias("axis"), st_g.alias("status"), F.col("ground_score").alias("v")))
    e = df.select("key", F.inline(rows))
    return e.select("key", "axis", "status",
                    F.when(F.col("status") == "scored", F.col("v")).alias("score"))


def bucket_label(score: Column) -> Column:
    good, avg, chk = K.BUCKET_LABELS
    return (F.when(score.isNull(), F.lit(None).cast("string"))
            .when(score >= K.BUCKET_GOOD, F.lit(good))
            .when(score >= K.BUCKET_AVERAGE, F.lit(avg)).otherwise(F.lit(chk)))


def fmt_fixed(v: Column, digits: int, suffix: str = "") -> Column:
    """Fixed decimals, dash for NULL.  The value is first rounded to 6
    decimals (float noise), then half-up to the shown digits."""
    r = F.round(F.round(v, 6), digits)
    return F.coalesce(F.concat(F.format_string(f"%.{digits}f", r), F.lit(suffix)), F.lit("—"))


def fmt_pct(v: Column) -> Column:
    return fmt_fixed(F.round(v, 6) * F.lit(100.0), 1, "%")


def fmt_int(v: Column, suffix: str = "") -> Column:
    return F.coalesce(F.concat(F.format_number(v.cast("long"), 0), F.lit(suffix)), F.lit("—"))
