"""Queries over the combined table, the marts and the serving layer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from . import serve as S
from ..operators.compare import differing_rows
from ..sources.staging import unstaged
from .combine import combine
from .common import round_doubles
from .marts import mart_hazard, mart_scores, mart_towns
from .zones import hazard_polys


def q_combine_scores(spark: SparkSession, d: str) -> DataFrame:
    m = combine(spark, d)
    return round_doubles(m.select(
        "zone", "safety_score", "flood_score", "tide_score", "ground_score", "elev_score",
        "flood_exposure", "tokyo_exposure", "nat_exposure", "flood_source", "tide_exposure",
        "business_area_flag", "scored"))


def q_mart_towns(spark: SparkSession, d: str) -> DataFrame:
    t = mart_towns(spark, d)
    return round_doubles(t.withColumn("lat", F.round("lat", 6)).withColumn("lng", F.round("lng", 6)))


def q_mart_scores(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(mart_scores(spark, d))


def q_mart_hazard(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(mart_hazard(spark, d))


def q_index(spark: SparkSession, d: str) -> DataFrame:
    i = S.index(spark, d).orderBy("ward", "town")
    return round_doubles(i.select("key", "ward", "town", "population", "safety_score",
                                  "flood_score", "tide_score", "ground_score", "scored",
                                  "flood_covered", "tide_in_scope", "liq_covered"))


def q_masked_index(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(S.masked(S.index(spark, d)).drop("lat", "lng"))


def q_index_meta(spark: SparkSession, d: str) -> DataFrame:
    i = S.masked(S.index(spark, d))
    return i.agg(F.count(F.lit(1)).alias("town_count"),
                 F.count_if("scored").alias("scored_count"),
                 F.array_join(F.array_sort(F.collect_set("ward")), ",").alias("wards"))


def q_ward_codes(spark: SparkSession, d: str) -> DataFrame:
    return mart_towns(spark, d).select("ward", "ward_code").distinct()


def q_ward_map(spark: SparkSession, d: str) -> DataFrame:
    """The ward-to-code map of the index metadata, as one JSON object (bounded by the wards)."""
    codes = q_ward_codes(spark, d).where(F.col("ward_code").isNotNull())
    return codes.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_set(F.struct("ward", "ward_code"))))).alias("ward_codes"))


DETAIL = ("key", "ward", "town", "population", "safety_score", "flood_score", "tide_score", "ground_score",
          "serious_2y", "daily_r", "total_r", "flood_ratio", "tide_ratio", "liq_points", "nat_rivers", "flood_source")
ONE_KEY = 7


def q_town_detail(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(S.detail(spark, d).select(*DETAIL))


def q_town_one(spark: SparkSession, d: str) -> DataFrame:
    """The detail record of one key, read from the row groups that hold it."""
    return round_doubles(S.detail(spark, d, key=ONE_KEY).select(*DETAIL))


def q_town_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested record per key, serialised with NULL fields kept."""
    j = S.detail(spark, d)
    rec = F.struct(
        F.col("key"), F.col("ward"), F.col("town"), F.col("population").alias("pop"),
        F.struct(*[F.col(f"{a}_score").alias(a) for a in S.AXES]).alias("scores"),
        F.struct((F.col("scored") == 1).alias("scored"),
                 (F.col("flood_covered") == 1).alias("flood_covered"),
                 (F.col("tide_in_scope") == 1).alias("tide_in_scope"),
                 (F.col("below_sea") == 1).alias("below_sea"),
                 (F.col("business_area") == 1).alias("business_area"),
                 (F.col("liq_covered") == 1).alias("liq_covered"),
                 (F.col("collapse_zone") == 1).alias("collapse_zone"),
                 (F.col("national_river") == 1).alias("national_river")).alias("flags"),
        F.struct("serious_2y", "serious_r", "daily_r", "total_r").alias("crime"),
        F.struct("flood_ratio", "flood_mean_depth", "flood_max_depth", "tide_ratio",
                 "tide_mean_depth", "liq_points", "liq_pl", "nat_ratio", "nat_exposure",
                 "tokyo_exposure", "flood_source", "nat_rivers").alias("hazard"))
    return j.select("key", F.to_json(rec, {"ignoreNullFields": "false"}).alias("json"))


def q_axis_corr(spark: SparkSession, d: str) -> DataFrame:
    m = combine(spark, d).where(F.col("safety_score").isNotNull() & F.col("flood_score").isNotNull()
                                & F.col("tide_score").isNotNull() & F.col("ground_score").isNotNull())
    pairs = [(a, b) for i, a in enumerate(S.AXES) for b in S.AXES[i + 1:]]
    return round_doubles(m.agg(*[F.corr(f"{a}_score", f"{b}_score").alias(f"corr_{a}_{b}")
                                 for a, b in pairs]))


def q_axis_status(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(S.axis_status(S.index(spark, d)))


def evidence(df: DataFrame) -> DataFrame:
    """(key, axis, idx, label, value) evidence rows; the flood list depends
    on which source decided the score, the basin only below 40 points."""
    decided_nat = (F.col("national_river") == 1) & (F.col("flood_source") == K.FLOOD_SOURCE_NATIONAL)
    show_basin = ((F.col("scored") == 1) & (F.col("flood_covered") == 1) & ~decided_nat
                  & (F.col("flood_score") < K.BUCKET_AVERAGE) & F.col("flood_basin").isNotNull())
    factor = F.when(decided_nat, F.coalesce(F.col("nat_rivers"), F.lit(K.FLOOD_SOURCE_NATIONAL))) \
        .when(show_basin, F.col("flood_basin"))
    expo = F.when(decided_nat, F.col("nat_exposure")).otherwise(F.col("tokyo_exposure"))
    hist = (F.when(F.col("liq_1923") == 1, "1923").when(F.col("liq_2011") == 1, "2011")
            .when(F.col("liq_history") == 1, "recorded").otherwise("none"))
    ev = lambda axis, label, value: F.struct(F.lit(axis).alias("axis"), F.lit(label).alias("label"),
                                             value.alias("value"))
    items = F.array(
        ev("flood", "main factor", factor),
        ev("flood", "flooded share", S.fmt_pct(F.col("flood_ratio"))),
        ev("flood", "mean depth", S.fmt_fixed(F.col("flood_mean_depth"), 2, " m")),
        ev("flood", "max depth", S.fmt_fixed(F.col("flood_max_depth"), 2, " m")),
        ev("flood", "area-averaged depth", S.fmt_fixed(expo, 2, " m")),
        ev("tide", "flooded share", S.fmt_pct(F.col("tide_ratio"))),
        ev("tide", "mean depth", S.fmt_fixed(F.col("tide_mean_depth"), 2, " m")),
        ev("tide", "max depth", S.fmt_fixed(F.col("tide_max_depth"), 2, " m")),
        ev("ground", "past liquefaction", hist),
        ev("ground", "large", S.fmt_int(F.col("liq_large"), " pts")),
        ev("ground", "mid", S.fmt_int(F.col("liq_mid"), " pts")),
        ev("ground", "small", S.fmt_int(F.col("liq_small"), " pts")),
        ev("ground", "PL smoothed", S.fmt_fixed(F.col("liq_pl"), 1)),
        ev("ground", "borings", S.fmt_int(F.col("liq_points"), " pts")))
    e = df.select("key", F.posexplode(F.filter(items, lambda s: s["value"].isNotNull()))
                  .alias("idx", "item"))
    return e.select("key", F.col("item.axis").alias("axis"), "idx",
                    F.col("item.label").alias("label"), F.col("item.value").alias("value"))


def q_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = mart_scores(spark, d).drop("data_year")
    h = mart_hazard(spark, d).drop("data_year")
    return evidence(s.join(h, "key")).withColumn("idx", F.col("idx").cast("long"))


def card_summary(df: DataFrame) -> DataFrame:
    sc = F.array(*[F.struct(F.lit(a).alias("a"), F.col(c).alias("v"))
                   for a, c in zip(S.AXES, ("s", "f", "t", "g"))])
    best = F.transform(F.filter(sc, lambda x: x["v"] >= K.BUCKET_GOOD), lambda x: x["a"])
    worst = F.transform(F.filter(sc, lambda x: x["v"] < K.BUCKET_AVERAGE), lambda x: x["a"])
    unk = F.transform(F.filter(sc, lambda x: x["v"].isNull()), lambda x: x["a"])
    return df.select("key", F.array_join(best, ",").alias("best"),
                     F.array_join(worst, ",").alias("worst"),
                     F.array_join(unk, ",").alias("unknown"),
                     ((F.size(best) == 4) & (F.size(unk) == 0)).alias("all_good"))


def q_card_summary(spark: SparkSession, d: str) -> DataFrame:
    return card_summary(S.masked(S.index(spark, d)))


def _all_four(m: DataFrame, lo: float = K.BUCKET_GOOD) -> DataFrame:
    return m.where((F.col("scored")) & (F.col("safety_score") >= lo) & (F.col("flood_score") >= lo)
                   & (F.col("tide_score") >= lo) & (F.col("ground_score") >= lo))


def q_all_good_measured(spark: SparkSession, d: str) -> DataFrame:
    g = _all_four(combine(spark, d))
    return g.groupBy("ward").agg(F.count(F.lit(1)).alias("n_all_good"),
                                 F.count_if("tide_in_scope").alias("n_measured"),
                                 F.sum(F.when(F.col("tide_in_scope"), F.col("pop"))
                                       .otherwise(F.lit(0.0))).alias("pop_measured")) \
        .transform(round_doubles)


def typhoon_specific(df: DataFrame) -> DataFrame:
    return df.where(F.col("f").isNotNull() & F.col("t").isNotNull() & F.col("tide_scope")
                    & (F.col("f") >= K.TYPHOON_FLOOD_MIN) & (F.col("t") <= K.TYPHOON_TIDE_MAX))


def q_typhoon_specific(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(typhoon_specific(S.masked(S.index(spark, d)))
                         .select("key", "ward", "f", "t"))


def q_safety_flood_gap(spark: SparkSession, d: str) -> DataFrame:
    m = S.masked(S.index(spark, d))
    return round_doubles(m.where((F.col("s") >= K.BUCKET_GOOD) & (F.col("f") < K.BUCKET_AVERAGE))
                         .select("key", "ward", "s", "f"))


def q_flood_tide_gap(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    m = combine(spark, d).where(F.col("scored") & F.col("flood_score").isNotNull()
                                & F.col("tide_score").isNotNull() & F.col("ground_score").isNotNull())
    g = m.withColumn("diff", F.col("flood_score") - F.col("tide_score"))
    return round_doubles(g.orderBy(F.desc("diff"), "zone").limit(k)
                         .select("zone", "ward", "flood_score", "tide_score", "tide_exposure", "diff"))


def q_national_decided(spark: SparkSession, d: str, k: int = 6) -> DataFrame:
    m = combine(spark, d).where(F.col("scored") & F.col("flood_score").isNotNull()
                                & (F.col("flood_source") == K.FLOOD_SOURCE_NATIONAL))
    return round_doubles(m.orderBy(F.desc("nat_exposure"), "zone").limit(k)
                         .select("zone", "ward", "flood_score", "tokyo_exposure", "nat_exposure",
                                 "nat_rivers"))


def q_score_bucket(spark: SparkSession, d: str) -> DataFrame:
    m = S.masked(S.index(spark, d))
    return m.select("key", *[S.bucket_label(F.col(c)).alias(f"{a}_bucket")
                             for a, c in zip(S.AXES, ("s", "f", "t", "g"))])


def q_ward_rollup(spark: SparkSession, d: str) -> DataFrame:
    m = combine(spark, d).where(F.col("tide_exposure") > 0)
    r = m.groupBy("ward").agg(F.count(F.lit(1)).alias("n"), F.avg("tide_exposure").alias("expo"),
                              F.sum("pop").alias("pop"))
    return round_doubles(r.orderBy(F.desc("expo"), "ward"))


def q_dq_status(spark: SparkSession, d: str) -> DataFrame:
    st = S.axis_status(S.index(spark, d))
    m = combine(spark, d)
    bad_status = st.agg(F.count_if(((F.col("status") == "scored") & F.col("score").isNull())
                                   | ((F.col("status") != "scored") & F.col("score").isNotNull()))
                        .alias("status_violations"))
    bad_scope = m.agg(F.count_if(~F.col("tide_in_scope") & (F.col("tide_exposure") != 0))
                      .alias("out_of_scope_exposure"))
    return bad_status.select("status_violations", bad_scope.scalar().alias("out_of_scope_exposure"))


def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    """One feature per area that has a polygon (by its alias): key/ward/town
    properties + rounded geometry."""
    from ..functions import geo as G
    from .geo_queries import polygons, resolve
    z = resolve(spark, d).select(F.col("key").alias("zone"), "poly_key").join(polygons(spark, d), "poly_key")
    t = mart_towns(spark, d).select("key", "ward", "town", "ward_code")
    f = (z.select(F.col("zone").alias("key"), G.snap("rings", 6).alias("snapped"))
         .withColumn("geometry", G.col(G.geometry_sql("snapped"))).join(t, "key"))
    return f.select("key", "ward_code", F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("key", "ward", "town")),
        F.lit(',"geometry":'), "geometry", F.lit("}")).alias("feature"))


def q_geojson_features(spark: SparkSession, d: str) -> DataFrame:
    return geojson_features(spark, d)


def scored_features(features: DataFrame, entries: DataFrame) -> DataFrame:
    """The features of listed areas with their axis scores as properties.

    An axis without a value is no property at all, so a reader can't take it
    for a score of 0. ``entries`` is the masked index; features without an
    entry are left out.
    """
    e = entries.select("key", F.to_json(F.struct("key", "ward", "town", "s", "f", "t", "g")).alias("properties"))
    geometry = F.get_json_object("feature", "$.geometry")
    return features.join(e, "key").select("key", "ward_code", F.concat(
        F.lit('{"type":"Feature","id":'), F.col("key").cast("string"), F.lit(',"properties":'), "properties",
        F.lit(',"geometry":'), geometry, F.lit("}")).alias("feature"))


def q_scored_features(spark: SparkSession, d: str) -> DataFrame:
    """Scores and axis names as they stand in the features."""
    f = scored_features(geojson_features(spark, d), S.masked(S.index(spark, d)))
    p = f.select("key", F.get_json_object("feature", "$.properties").alias("p"))
    number = lambda a: F.round(F.get_json_object("p", f"$.{a}").cast("double"), 6).alias(a)
    return p.select("key", F.get_json_object("p", "$.town").alias("town"),
                    F.array_join(F.json_object_keys("p"), ",").alias("names"), *[number(a) for a in "sftg"])


def q_geojson_split(spark: SparkSession, d: str) -> DataFrame:
    """A8: the hazards as feature collections, one a task, read back in byte ranges."""
    from ..functions import geo as G
    from ..session import shared_folder
    from ..sources.files import load_geojson_split
    from ..sources.geojson_split import write_collections
    f = hazard_polys(spark, d).select(F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("poly_id", "river")),
        F.lit(',"geometry":'), G.col(G.geometry_sql("rings")), F.lit("}")).alias("feature"))
    folder = f"{shared_folder(spark)}/geojson-{uuid.uuid4().hex}"
    write_collections(f, folder)
    back = load_geojson_split(spark, folder)
    return round_doubles(back.select(F.col("properties")["poly_id"].cast("long").alias("poly_id"), F.col("properties")["river"].cast("long").alias("river"),
                                     F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r)).cast("long").alias("n_vertices"),
                                     G.area("rings").alias("area"), "valid"))


def q_dq_set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Feature keys against the areas that claim a polygon, and (the hatched
    set) features without a safety score against areas that aren't scored."""
    from ..operators.quality import set_difference_counts
    feats = geojson_features(spark, d).select("key")
    claimed = mart_towns(spark, d).where("has_polygon = 1").select("key")
    idx = S.index(spark, d).select("key", "safety_score", "scored")
    hatched = feats.join(idx, "key", "left").where("safety_score IS NULL").select("key")
    unscored = claimed.join(idx.where("scored = 0").select("key"), "key", "left_semi")
    h = set_difference_counts(hatched, unscored)
    return set_difference_counts(feats, claimed).select(
        F.col("only_left").alias("missing_in_index"), F.col("only_right").alias("missing_in_features"),
        h.select(F.col("only_left") + F.col("only_right")).scalar().alias("hatched_difference"))


def q_rebuild_diff(spark: SparkSession, d: str) -> DataFrame:
    """Staged scores vs a rebuild from the sources, compared on all columns."""
    a = round_doubles(combine(spark, d).select("zone", "safety_score", "flood_score", "tide_score",
                                               "ground_score"))
    with unstaged():
        b = round_doubles(combine(spark, d).select("zone", "safety_score", "flood_score",
                                                   "tide_score", "ground_score"))
    left, right, _ = differing_rows(a, b, ["zone"])
    n = right.agg(F.count("*").alias("n"))
    return left.agg(F.count("*").alias("only_staged")).select("only_staged", n.scalar().alias("only_rebuilt"))

