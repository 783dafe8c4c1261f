"""Area names: ward prefix split, key normalisation, search, slugs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..operators import search as G
from ..sources import testdata as T
from ..sources.staging import staged


def fixture_wards() -> list[str]:
    return [f"ward{i:02d}" for i in range(K.FIXTURE_WARD_COUNT)]


def split_names(df: DataFrame, name: str, wards) -> DataFrame:
    """Ward by prefix, non-area rows removed, town = rest, composite key."""
    w = X.ward_of(F.col(name), wards)
    d = df.withColumn("ward", w)
    keep = (F.col("ward").isNotNull()
            & ~F.col(name).contains(K.EXCLUDE_CONTAINS)
            & ~F.col(name).endswith(K.EXCLUDE_SUFFIX)
            & ~F.col(name).isin(*wards))
    d = d.where(keep).withColumn("town", F.substr(F.col(name), F.length("ward") + 1))
    # the normalised town is its own column so it is computed once and reused
    d = X.with_norm_name(d, "town", "town_norm")
    return d.withColumn("name_key", F.concat_ws(K.KEY_SEPARATOR, F.col("ward"), F.col("town_norm")))


def named_areas(spark: SparkSession, d: str) -> DataFrame:
    """The area-name dimension (one row per area), staged once."""
    return staged(spark, "named_areas", d,
                  lambda: split_names(T.area_names(spark, d), "raw_name", fixture_wards()))


def search_names(spark: SparkSession, d: str) -> DataFrame:
    """key, ward, town, search_key of every area; the search key is made once."""
    return staged(spark, "search_names", d, lambda: named_areas(spark, d).select(
        "key", "ward", "town", X.search_norm(F.concat("ward", "town")).alias("search_key")))


def search_index(spark: SparkSession, d: str) -> DataFrame:
    """Trigrams of the search keys, laid out by trigram (and key: most names share the block suffix)."""
    return staged(spark, "search_index", d, lambda: G.trigram_rows(search_names(spark, d)), cluster_by=["gram", "key"])


def search_counts(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "search_counts", d, lambda: G.gram_counts(search_index(spark, d)), cluster_by=["gram"])


def search(spark: SparkSession, d: str, query: str, ward: str | None = None, n: int = 60) -> DataFrame:
    """First n entries (list order: ward, town) whose normalised ward+town
    contains the normalised query; an empty query matches everything."""
    wanted = spark.range(1).select(X.search_norm(F.lit(query)).alias("q")).first()["q"]
    found = search_names(spark, d) if wanted == "" else \
        G.containing(search_index(spark, d), search_counts(spark, d), wanted)
    if ward:
        found = found.where(F.col("ward") == ward)
    return found.select("key", "ward", "town").orderBy("ward", "town", "key").limit(n)


def slug_table(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "slug_table", d, lambda: _slug_table(spark, d))


def _slug_table(spark: SparkSession, d: str) -> DataFrame:
    """Slug dimension: ward slug per ward, town slug per key, of all areas."""
    return named_areas(spark, d).select("key", "ward", F.concat(F.lit("w"), F.substring("ward", 5, 2)).alias("ward_slug"),
                    F.concat(F.lit("t"), F.col("key").cast("string"), F.lit("-"),
                             F.regexp_extract(F.col("town_norm"), "([0-9]+)丁目$", 1))
                    .alias("town_slug"))


def slug_lookup(spark: SparkSession, d: str) -> DataFrame:
    """key -> (ward_slug, town_slug), NULL when either is missing."""
    a = named_areas(spark, d).select("key", "ward")
    s = slug_table(spark, d)
    ws = s.select("ward", "ward_slug").distinct()
    ts = s.select("key", "town_slug")
    j = a.join(ws, "ward", "left").join(ts, "key", "left")
    ok = F.col("ward_slug").isNotNull() & F.col("town_slug").isNotNull()
    return j.select("key", F.when(ok, F.col("ward_slug")).alias("ward_slug"),
                    F.when(ok, F.col("town_slug")).alias("town_slug"))


def key_from_slugs(spark: SparkSession, d: str, paths: DataFrame) -> DataFrame:
    """(ward_slug, town_slug) -> key via the slug dimension (slugs unique)."""
    s = slug_table(spark, d).select("key", "ward_slug", "town_slug")
    return paths.join(s, ["ward_slug", "town_slug"], "left")
