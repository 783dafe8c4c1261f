"""Queries over generated area names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from . import names as N

SEARCH_QUERY = "１丁目"
SHORT_QUERY = "９ 二"


def q_ward_prefix(spark: SparkSession, d: str) -> DataFrame:
    return N.named_areas(spark, d).select("key", "ward", "town", "name_key")


def q_norm_name(spark: SparkSession, d: str) -> DataFrame:
    """Full-NFKC normaliser, evaluated once per DISTINCT town name and
    joined back (the Python UDF never sees duplicates)."""
    a = N.named_areas(spark, d).select("key", "town")
    dn = a.select("town").distinct().withColumn("norm", X.norm_name_nfkc(F.col("town")))
    return a.join(dn, "town").select("key", "town", "norm")


def q_kanji_number(spark: SparkSession, d: str) -> DataFrame:
    a = N.named_areas(spark, d)
    num = F.regexp_extract(F.col("town"), f"([{K.KANJI_DIGITS}{K.KANJI_TEN}]+){K.BLOCK_SUFFIX}$", 1)
    return a.where(num != "").select("key", num.alias("numeral"),
                                     X.kanji_number(num).alias("value"))


def q_search_normalize(spark: SparkSession, d: str) -> DataFrame:
    return N.search_names(spark, d).select("key", "search_key")


def q_town_search(spark: SparkSession, d: str) -> DataFrame:
    return N.search(spark, d, SEARCH_QUERY)


def q_ward_search(spark: SparkSession, d: str) -> DataFrame:
    """A query of two characters within one ward."""
    return N.search(spark, d, SHORT_QUERY, ward=N.fixture_wards()[3])


def q_slug_lookup(spark: SparkSession, d: str) -> DataFrame:
    return N.slug_lookup(spark, d)


def q_detail_paths(spark: SparkSession, d: str) -> DataFrame:
    s = N.slug_lookup(spark, d).where(F.col("town_slug").isNotNull())
    back = N.key_from_slugs(spark, d, s.select("ward_slug", "town_slug")) \
        .select("ward_slug", "town_slug", F.col("key").alias("key_back"))
    return s.join(back, ["ward_slug", "town_slug"]).select(
        "key", F.concat(F.lit("/area/"), F.col("ward_slug"), F.lit("/"), F.col("town_slug"))
        .alias("path"), "key_back")

