"""Queries over noded edges: ring repair, outlines of unions, points in a ring of many vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import arrangement as A
from ..operators.dissolve import boundary_rings, outline_boundary
from ..sources import testdata as T
from ..sources.staging import staged
from .common import round_doubles
from .zones import hazard_polys


def repaired_rings(spark: SparkSession, d: str) -> DataFrame:
    """Valid rings of the crossed fixture rings (staged once)."""
    return staged(spark, "repaired_rings", d, lambda: A.repaired(T.crossed_rings(spark, d), "poly_id", "rings"))


def q_ring_repair(spark: SparkSession, d: str) -> DataFrame:
    """J7: rings by the even-odd rule; area, rings, holes, and whether the result meets itself anywhere."""
    r = repaired_rings(spark, d)
    e = A.polygon_edges(r.withColumn("_rs", F.array("ring")), "poly_id", "_rs", 1e-8)
    bad = A.flawed(e).select(F.col("_k").alias("poly_id"), F.lit(True).alias("_bad"))
    out = r.groupBy("poly_id").agg(F.round(F.sum("area"), 5).alias("area"), F.count("*").alias("n_rings"),
                                   F.count_if(F.col("area") < 0).alias("n_holes"))
    return out.join(bad, "poly_id", "left").select("poly_id", "area", "n_rings", "n_holes", F.col("_bad").isNull().alias("valid"))


def q_union_outline(spark: SparkSession, d: str) -> DataFrame:
    """J8, J10: the outline of all hazards of a river as rings; its area is that of their union."""
    bound = outline_boundary(hazard_polys(spark, d), "river", "rings", digits=7)
    rings = boundary_rings(bound, "river", digits=7)
    return rings.groupBy("river").agg(F.round(F.sum("area"), 3).alias("area"), F.round(F.sum("perimeter"), 3).alias("perimeter"))


def q_big_ring_count(spark: SparkSession, d: str) -> DataFrame:
    """D5: depth points inside one ring that has a vertex a part, by basin."""
    cells = A.cover(T.big_ring_edges(spark, d), K.FIXTURE_CELL * 4, A.CROWD, inside=True, gather=False)
    inside = A.points_in_crowded(T.points(spark, d).select("x", "y", "basin", "depth"), cells, K.FIXTURE_CELL * 4, "x", "y", "ring")
    return round_doubles(inside.groupBy("basin").agg(F.count("*").alias("n_points"), F.max("depth").alias("depth_max")))
