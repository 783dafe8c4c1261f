"""Per-zone axes from point data: flood statistics, tide exposure, ground."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo as G
from ..operators.ranking import top1
from ..operators.overlay import intersects_sliced
from ..operators.spatial import zone_cells, zone_join
from ..sources import testdata as T
from ..sources.staging import staged


def zone_polys(spark: SparkSession, d: str) -> DataFrame:
    """zone, ward, name, region, rings, zone_area (staged once)."""
    def build():
        z = T.zones(spark, d)
        z = z.withColumn("rings", F.array("ring")).drop("ring")
        return z.withColumn("zone_area", G.area("rings"))
    return staged(spark, "zone_polys", d, build)


def hazard_polys(spark: SparkSession, d: str) -> DataFrame:
    """poly_id, river, rk, cx, cy, rings (staged once)."""
    def build():
        h = T.hazards(spark, d)
        return h.withColumn("rings", F.array("ring")).drop("ring")
    return staged(spark, "hazard_polys", d, build)


def zone_cover(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The grid cells of the zones (staged once) and their deepest level."""
    cells = staged(spark, "zone_cover", d,
                   lambda: zone_cells(zone_polys(spark, d), "zone", "rings", K.FIXTURE_CELL)[0])
    return cells, cells.agg(F.max("_l")).first()[0] or 0


def join_zones(points: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return zone_join(points, zone_polys(spark, d), key="zone", cell=K.FIXTURE_CELL,
                     cells=zone_cover(spark, d))


def points_in_zones(spark: SparkSession, d: str) -> DataFrame:
    return join_zones(T.points(spark, d), spark, d)


def zone_basin_table(spark: SparkSession, d: str) -> DataFrame:
    """The (zone, basin) accumulators of the depth points: the only pass
    over the points, staged once per session (zones x basins rows)."""
    return staged(spark, "zone_basin", d,
                  lambda: zone_basin_stats(points_in_zones(spark, d)))


# --- flood: per-zone point statistics ----------------------------------------

def zone_basin_stats(joined: DataFrame) -> DataFrame:
    """ONE aggregate over the joined points, keyed by (zone, basin); every
    accumulator is mergeable, so zone totals are rolled up from it."""
    return joined.groupBy("zone", "basin").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("depth") > 0).alias("n_flood"),
        F.sum("depth").alias("depth_sum"), F.max("depth").alias("depth_max"),
        F.sum("elev").alias("elev_sum"), F.min("elev").alias("elev_min"))


def zone_stats(zb: DataFrame) -> DataFrame:
    return zb.groupBy("zone").agg(
        F.sum("n").alias("n"), F.sum("n_flood").alias("n_flood"),
        F.sum("depth_sum").alias("depth_sum"), F.max("depth_max").alias("depth_max"),
        F.sum("elev_sum").alias("elev_sum"), F.min("elev_min").alias("elev_min"))


def basin_list(zb: DataFrame) -> DataFrame:
    """Basins with flooded points, most flooded first (ties: name)."""
    pos = zb.where(F.col("n_flood") > 0)
    srt = F.array_sort(F.collect_list(F.struct((-F.col("n_flood")).alias("k"),
                                               F.col("basin").alias("b"))))
    return pos.groupBy("zone").agg(
        F.array_join(F.transform(srt, lambda s: s["b"]), K.BASIN_LIST_SEPARATOR).alias("tk_basins"))


def flood_by_zone(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "flood_by_zone", d, lambda: _flood_by_zone(spark, d))


def _flood_by_zone(spark: SparkSession, d: str) -> DataFrame:
    zb = zone_basin_table(spark, d)
    st = zone_stats(zb)
    main = top1(zb.where(F.col("n_flood") > 0), ["zone"], "n_flood", "basin",
                ["basin", "n_flood"], prefix="main_")
    lst = basin_list(zb)
    z = zone_polys(spark, d).select("zone")
    m = z.join(st, "zone", "left").join(main, "zone", "left").join(lst, "zone", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    cov = n > 0
    return m.select(
        "zone",
        cov.alias("tk_coverage"),
        n.cast("long").alias("tk_n"),
        F.when(cov, F.col("n_flood") / F.col("n")).alias("tk_flood_ratio"),
        F.when(cov, F.try_divide(F.col("depth_sum"), F.nullif(F.col("n_flood"), F.lit(0))))
        .alias("tk_mean_depth"),
        F.when(cov, F.greatest(F.col("depth_max"), F.lit(0.0))).alias("tk_max_depth"),
        F.when(cov, F.col("elev_sum") / F.col("n")).alias("tk_mean_elev"),
        F.when(cov, F.col("elev_min")).alias("tk_min_elev"),
        F.coalesce(F.when(cov, F.col("elev_sum") / F.col("n")) < 0, F.lit(False))
        .alias("tk_below_sea"),
        F.col("main_basin").alias("tk_main_basin"),
        F.when(cov, F.try_divide(F.col("main_n_flood"), F.nullif(F.col("n_flood"), F.lit(0))))
        .alias("tk_main_basin_ratio"),
        "tk_basins")


# --- tide ------------------------------------------------------------------

def tide_by_zone(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "tide_by_zone", d, lambda: _tide_by_zone(spark, d))


def _tide_by_zone(spark: SparkSession, d: str, cell_area: float = K.FIXTURE_TIDE_CELL_AREA) -> DataFrame:
    """Flooded cells (points with depth > 0) per zone -> area ratio, mean
    depth inside the flooded part, max depth, exposure = ratio * mean."""
    cells = T.points(spark, d).where(F.col("depth") > 0)
    j = join_zones(cells, spark, d)
    a = j.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("s"),
                              F.max("depth").alias("mx"))
    z = zone_polys(spark, d).select("zone", "zone_area", "region")
    # no exposure exists outside the scope of the tide data
    m = z.join(a, "zone", "left")
    inside = ~F.col("region").isin(*K.FIXTURE_TIDE_OUT_REGIONS)
    for c in ("n", "s", "mx"):
        m = m.withColumn(c, F.when(inside, F.col(c)))
    n = F.coalesce(F.col("n"), F.lit(0))
    ratio = F.least(F.greatest(F.try_divide(n * F.lit(cell_area), F.col("zone_area")),
                               F.lit(0.0)), F.lit(1.0))
    mean = F.coalesce(F.try_divide(F.col("s"), F.nullif(n, F.lit(0))), F.lit(0.0))
    return m.select("zone", "region", n.cast("long").alias("ts_n"),
                    ratio.alias("ts_flood_ratio"), mean.alias("ts_mean_depth"),
                    F.coalesce(F.col("mx"), F.lit(0.0)).alias("ts_max_depth"),
                    (ratio * mean).alias("ts_exposure"))


# --- ground ------------------------------------------------------------------

def pl_weights(spark: SparkSession) -> DataFrame:
    """The boring class code table (a bounded literal)."""
    return spark.createDataFrame(list(K.FIXTURE_PL_WEIGHTS.items()), "cls string, w double")


def unknown_codes(borings: DataFrame, codes: DataFrame) -> DataFrame:
    return borings.select("cls").where(F.col("cls").isNotNull()) \
        .join(codes, "cls", "left_anti").distinct()


def assert_known_codes(borings: DataFrame, codes: DataFrame) -> None:
    bad = [r.cls for r in unknown_codes(borings, codes).limit(20).collect()]
    if bad:
        raise ValueError(f"unknown class values: {bad}")


def borings_in_zones(spark: SparkSession, d: str) -> DataFrame:
    """Borings with their zone and class weight (staged once per session)."""
    return staged(spark, "borings_in_zones", d, lambda: _borings_in_zones(spark, d))


def _borings_in_zones(spark: SparkSession, d: str) -> DataFrame:
    b = T.borings(spark, d)
    w = pl_weights(spark)
    assert_known_codes(b, w)       # an unknown class must stop the build, not weigh nothing
    bw = b.join(F.broadcast(w), "cls", "left")
    return join_zones(bw, spark, d)


def class_counts(j: DataFrame) -> DataFrame:
    return j.groupBy("zone").agg(
        F.count(F.lit(1)).alias("liq_points"), F.sum("w").alias("liq_sum"),
        F.count_if(F.col("cls") == "small").alias("liq_small"),
        F.count_if(F.col("cls") == "mid").alias("liq_mid"),
        F.count_if(F.col("cls") == "large").alias("liq_large"))


def ground_by_zone(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "ground_by_zone", d, lambda: _ground_by_zone(spark, d))


def _ground_by_zone(spark: SparkSession, d: str) -> DataFrame:
    j = borings_in_zones(spark, d)
    cc = class_counts(j)
    prior = j.agg(F.avg("w")).scalar()        # scalar subquery, evaluated once
    z = zone_polys(spark, d).select("zone")
    m = z.join(cc, "zone", "left")
    cov = F.col("liq_points").isNotNull()
    pp = F.lit(K.PRIOR_POINTS)
    return m.select(
        "zone",
        F.coalesce(F.col("liq_points"), F.lit(0)).cast("long").alias("liq_points"),
        F.coalesce(F.col("liq_small"), F.lit(0)).cast("long").alias("liq_small"),
        F.coalesce(F.col("liq_mid"), F.lit(0)).cast("long").alias("liq_mid"),
        F.coalesce(F.col("liq_large"), F.lit(0)).cast("long").alias("liq_large"),
        ((F.col("liq_sum") + pp * prior) / (F.col("liq_points") + pp)).alias("liq_pl"),
        (F.col("liq_sum") / F.col("liq_points")).alias("liq_pl_raw"),
        cov.alias("liq_covered"),
        (cov & (F.coalesce(F.col("liq_points"), F.lit(0)) <= K.THIN_POINTS)).alias("liq_thin"))


def history_flags(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, "history_flags", d, lambda: _history_flags(spark, d))


def _history_flags(spark: SparkSession, d: str) -> DataFrame:
    """Zones touched by any history polygon; one flag per history set.

    The fixture's three history sets are the hazard triangles of river 0
    (undated record), 1 (first event) and 2 (second event).
    """
    z = zone_polys(spark, d)
    h = hazard_polys(spark, d)
    hit = intersects_sliced(z.select("zone", "rings"), "zone", "rings",
                            h.select("poly_id", "rings"), "poly_id", "rings",
                            slab=K.FIXTURE_SLAB, cell=K.FIXTURE_PAIR_CELL)
    hit = hit.join(h.select("poly_id", "river"), "poly_id")
    per = hit.groupBy("zone").agg(
        F.lit(True).alias("liq_history"),
        F.bool_or(F.col("river") == 1).alias("liq_1923"),
        F.bool_or(F.col("river") == 2).alias("liq_2011"))
    f = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return z.select("zone").join(per, "zone", "left").select(
        "zone", f("liq_history"), f("liq_1923"), f("liq_2011"))
