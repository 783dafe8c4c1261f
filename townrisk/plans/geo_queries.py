"""Queries over the zone polygons alone (geometry functions, dissolve,
aliases, shared polygons, outlines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo as G
from ..operators.dissolve import boundary_rings, dissolve, outline_boundary, undirected
from ..sources import testdata as T
from ..sources.staging import staged
from .common import round_doubles
from .zone_queries import zone_population
from .zones import zone_polys


def q_ring_area(spark: SparkSession, d: str) -> DataFrame:
    z = zone_polys(spark, d)
    return round_doubles(z.select("zone", G.area("rings").alias("area")))


def q_ring_centroid(spark: SparkSession, d: str) -> DataFrame:
    z = zone_polys(spark, d)
    cx, cy = G.centroid("rings")
    return round_doubles(z.select("zone", cx.alias("cx"), cy.alias("cy")))


def vertices_lonlat(spark: SparkSession, d: str) -> DataFrame:
    z = zone_polys(spark, d)
    v = z.select("zone", F.posexplode(F.element_at("rings", 1)).alias("i", "p"))
    return v.select("zone", F.col("i").cast("long").alias("i"),
                    (F.lit(K.FIXTURE_LON0) + F.col("p.x") * F.lit(K.FIXTURE_DEG_PER_UNIT)).alias("lon"),
                    (F.lit(K.FIXTURE_LAT0) + F.col("p.y") * F.lit(K.FIXTURE_DEG_PER_UNIT)).alias("lat"))


def q_project(spark: SparkSession, d: str) -> DataFrame:
    v = G.with_plane_zone9(vertices_lonlat(spark, d), "lon", "lat", "px", "py")
    mx, my = G.to_web_mercator("lon", "lat")
    return v.select("zone", "i", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"),
                    F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"))


def q_snap_precision(spark: SparkSession, d: str) -> DataFrame:
    """Geographic rings rounded to 6 decimals (consecutive duplicates dropped)."""
    v = vertices_lonlat(spark, d)
    rings = v.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("i", "lon", "lat"))).alias("pts"))
    ring = F.transform("pts", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    s = rings.select("zone", F.array(ring).alias("_rs")) \
        .select("zone", F.element_at(G.snap("_rs", 6), 1).alias("r"))
    return s.select("zone", F.size("r").cast("long").alias("n_vertices"),
                    F.array_join(F.transform("r", lambda p: F.concat(
                        F.format_string("%.6f", p["x"]), F.lit(" "), F.format_string("%.6f", p["y"]))),
                        ",").alias("wkt_ring"))


def ward_outline(spark: SparkSession, d: str) -> DataFrame:
    """Directed boundary edges of the wards (staged once)."""
    return staged(spark, "ward_outline", d, lambda: outline_boundary(
        T.zone_squares(spark, d).withColumn("rings", F.array("ring")), "ward", "rings"))


def q_ward_outline_edges(spark: SparkSession, d: str) -> DataFrame:
    return undirected(ward_outline(spark, d), "ward")


def q_dissolve_attrs(spark: SparkSession, d: str) -> DataFrame:
    z = zone_polys(spark, d)
    g = dissolve(z, "region", sums=["zone_area"], firsts=["name"], order="zone", rings="rings")
    return round_doubles(g.select("region", F.col("zone_area").alias("area"), "name",
                                  F.size("rings").cast("long").alias("n_parts")))


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """The fixture's polygon table: zone rings keyed by poly_key, without
    the aliased zone and without the zone that has no polygon."""
    z = zone_polys(spark, d)
    drop = list(K.FIXTURE_ALIAS.keys()) + list(K.FIXTURE_NO_POLYGON)
    return z.where(~F.col("zone").isin(*drop)).select(F.col("zone").alias("poly_key"),
                                                      "rings", "zone_area")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.FIXTURE_ALIAS.items()), "key long, alias long")


def resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every area (zone) with its polygon key, identity when no alias."""
    z = zone_polys(spark, d).select(F.col("zone").alias("key"), "ward")
    a = z.join(F.broadcast(alias_table(spark)), "key", "left") \
        .withColumn("poly_key", F.coalesce("alias", "key")).drop("alias")
    p = polygons(spark, d).select("poly_key", "zone_area")
    return a.join(p, "poly_key", "left").select(
        "key", "ward", "poly_key", F.col("zone_area").isNotNull().alias("has_polygon"), "zone_area")


def q_alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    return resolve(spark, d).select("key", "poly_key", "has_polygon")


def q_shared_keys(spark: SparkSession, d: str) -> DataFrame:
    r = resolve(spark, d).where(F.col("has_polygon"))
    return r.groupBy("poly_key").agg(F.count(F.lit(1)).alias("n_areas")).where(F.col("n_areas") > 1)


def q_shared_polygon_key(spark: SparkSession, d: str) -> DataFrame:
    return shared_polygon_keys(spark, d)


def shared_polygon_keys(spark: SparkSession, d: str) -> DataFrame:
    """key -> polygon key when that polygon serves more than one area."""
    from pyspark.sql import Window
    r = resolve(spark, d)
    w = Window.partitionBy("poly_key")
    shared = F.when(F.col("has_polygon") & (F.count(F.lit(1)).over(w) > 1), F.col("poly_key"))
    return r.select("key", shared.alias("shared_polygon_key"))


def q_density(spark: SparkSession, d: str) -> DataFrame:
    r = resolve(spark, d).where(F.col("has_polygon"))
    p = zone_population(spark, d).withColumnRenamed("zone", "key")
    j = r.join(p, "key")
    # fixture units are km, so the area is already in km^2
    return round_doubles(j.select("key", "pop", F.col("zone_area").alias("area_km2"),
                                  (F.col("pop") / F.col("zone_area")).alias("density")))


def q_ward_outline_rings(spark: SparkSession, d: str) -> DataFrame:
    """Overview outlines: rings stitched per ward, simplified; area and
    perimeter per ward."""
    rings = boundary_rings(ward_outline(spark, d), "ward", tolerance=1e-4)
    return round_doubles(rings.groupBy("ward").agg(
        F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"),
        F.count(F.lit(1)).alias("n_rings")))


def q_ring_validity(spark: SparkSession, d: str) -> DataFrame:
    """J7: validity of every zone and hazard polygon (vertex count, at least
    three distinct vertices, boundary never meets itself)."""
    from ..operators.overlay import self_crossing
    from .zones import hazard_polys
    z = zone_polys(spark, d).select(F.lit("zone").alias("kind"), F.col("zone").alias("id"), "rings")
    h = hazard_polys(spark, d).select(F.lit("hazard").alias("kind"), F.col("poly_id").alias("id"), "rings")
    p = z.unionByName(h).withColumn("pk", F.concat_ws(":", "kind", F.col("id").cast("string")))
    bad = self_crossing(p, "pk", "rings", slab=K.FIXTURE_SLAB).withColumn("_x", F.lit(True))
    return p.join(bad, "pk", "left").select(
        "kind", "id", F.aggregate(F.transform("rings", F.size), F.lit(0), lambda a, n: a + n)
        .cast("long").alias("n_vertices"),
        G.rings_valid("rings").alias("enough_vertices"),
        F.col("_x").isNull().alias("simple"))


def overview_features(spark: SparkSession, d: str, tolerance: float = 1e-4) -> DataFrame:
    """B3: one GeoJSON feature per ward from the dissolved, simplified
    outline rings (closed; a MultiPolygon where a ward has several parts)."""
    r = boundary_rings(ward_outline(spark, d), "ward", tolerance=tolerance)
    g = r.groupBy("ward").agg(F.sort_array(F.collect_list(F.struct("ring_id", "ring"))).alias("parts"))
    g = g.withColumn("rings", F.transform("parts", lambda p: p["ring"]))
    return g.select("ward", F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("ward")),
                                     F.lit(',"geometry":'), G.col(G.geometry_sql("rings")), F.lit("}")).alias("feature"))
