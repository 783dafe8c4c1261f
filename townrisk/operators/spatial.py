"""Spatial joins as equi joins on grid cells plus an exact residual test.

A point-in-polygon join never compares every point with every polygon:
polygons are cut into grid cells once (a small table), points compute
their cell with two ``floor`` calls, and the equi join on the cell id is a
broadcast hash join or a shuffle join as Spark decides from the cell table's
bytes.  Cells with many edges are split (:func:`arrangement.cover`), so a
cell carries a bounded number of its own edges, however many vertices a
polygon has; the winding at the cell's corner stands for all others.  Cells
with no edge at all are either inside (kept, no test) or outside (dropped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from . import arrangement as A


def _cell_range(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / F.lit(size)).cast("long"),
                      F.floor(hi / F.lit(size)).cast("long"))


def zone_cells(zones: DataFrame, key: str, rings: str, cell: float, limit: int = A.LIMIT) -> tuple[DataFrame, int]:
    """The cells that the zones touch or hold, at most ``limit`` edges each, and the deepest level."""
    return A.cover(A.polygon_edges(zones, key, rings), cell, limit, inside=True)


def zone_join(points: DataFrame, zones: DataFrame, key: str = "zone",
              rings: str = "rings", cell: float = 2.0, x: str = "x", y: str = "y",
              cells: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Inner join of points with every zone that contains them (``within``
    up to the even-odd rule on edges).  Output: point columns + ``key``.

    A point inside several overlapping zones is returned once per zone.
    ``cells`` is what :func:`zone_cells` gave for these zones and this cell.
    """
    return A.points_in(points, cells or zone_cells(zones, key, rings, cell), cell, x, y, key)


def bbox_pairs(a: DataFrame, a_key: str, a_rings: str, b: DataFrame, b_key: str,
               b_rings: str, cell: float) -> DataFrame:
    """Pairs (a_key, b_key) whose bounding boxes intersect, without a cross
    join and without a distinct: both sides are exploded to grid cells of
    their box and a pair is kept only in the cell that holds the lower-left
    corner of the two boxes' intersection.  Keys are one row per polygon."""
    def boxed(df, k, r, p):
        xmin, ymin, xmax, ymax = G.bbox(r)
        d = df.select(F.col(k).alias(f"{p}key"), xmin.alias(f"{p}x0"), ymin.alias(f"{p}y0"),
                      xmax.alias(f"{p}x1"), ymax.alias(f"{p}y1"))
        return (d.withColumn("ci", F.explode(_cell_range(F.col(f"{p}x0"), F.col(f"{p}x1"), cell)))
                 .withColumn("cj", F.explode(_cell_range(F.col(f"{p}y0"), F.col(f"{p}y1"), cell))))
    ba, bb = boxed(a, a_key, a_rings, "a_"), boxed(b, b_key, b_rings, "b_")
    j = ba.join(bb, ["ci", "cj"])
    ix0 = F.greatest("a_x0", "b_x0")
    iy0 = F.greatest("a_y0", "b_y0")
    ok = ((ix0 <= F.least("a_x1", "b_x1")) & (iy0 <= F.least("a_y1", "b_y1"))
          & (F.floor(ix0 / F.lit(cell)) == F.col("ci"))
          & (F.floor(iy0 / F.lit(cell)) == F.col("cj")))
    return j.where(ok).select(F.col("a_key").alias(a_key), F.col("b_key").alias(b_key))


def intersects(a: DataFrame, a_key: str, a_rings: str, b: DataFrame, b_key: str,
               b_rings: str, cell: float) -> DataFrame:
    """Pairs of polygons that intersect (share at least one point): an edge
    of one crosses or touches an edge of the other, or one lies inside the
    other (tested with one vertex)."""
    pairs = bbox_pairs(a, a_key, a_rings, b, b_key, b_rings, cell)
    ga = a.select(F.col(a_key), G.poly_edges(a_rings).alias("_ea"),
                  F.element_at(F.element_at(F.col(a_rings), 1), 1).alias("_va"))
    gb = b.select(F.col(b_key), G.poly_edges(b_rings).alias("_eb"),
                  F.element_at(F.element_at(F.col(b_rings), 1), 1).alias("_vb"))
    j = pairs.join(ga, a_key).join(gb, b_key)
    cross = G.col(f"exists(_ea, ea -> exists(_eb, eb -> {G.segments_cross_sql('ea', 'eb')}))")
    a_in_b = G.inside("_va.x", "_va.y", "_eb")
    b_in_a = G.inside("_vb.x", "_vb.y", "_ea")
    return j.where(cross | a_in_b | b_in_a).select(a_key, b_key)
