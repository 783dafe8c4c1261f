"""Exact polygon overlay areas without a geometry library.

Both polygons are turned into *edge pieces* clipped to vertical x-slabs of
fixed width.  With sigma = +1 for edges running right-to-left (upper
boundary of a counter-clockwise ring) and -1 otherwise, the indicator of a
polygon on a vertical line is sum(sigma_e * H(y_e(x) - y)), hence

    area(A n B) = sum_{e in A} sum_{f in B} sigma_e sigma_f
                  * integral over the common x range of min(y_e(x), y_f(x)) dx

which holds for non-convex rings and holes.  The double sum only pairs
pieces of the same slab, so the work is an equi join on (pair, slab) and
a sum; the slab width bounds how many pieces ever meet in one group.
Overlaps among the B polygons are counted with multiplicity; for the area
of the *union* of B (no double counting) see :func:`union_area`, which nodes
the edges and keeps those where the covered region begins or ends.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from . import arrangement as A
from .sizing import cut_lineage
from .spatial import bbox_pairs


def edge_pieces(df: DataFrame, key: str, rings: str, slab: float) -> DataFrame:
    """key, slab, xa, xb, ya, yb, sg: non-vertical edges cut at slab borders."""
    e = df.select(F.col(key), F.explode(G.poly_edges(rings)).alias("e"))
    x1, y1, x2, y2 = F.col("e.x1"), F.col("e.y1"), F.col("e.x2"), F.col("e.y2")
    e = e.where(x1 != x2).select(
        key,
        F.least(x1, x2).alias("lx"), F.when(x1 < x2, y1).otherwise(y2).alias("ly"),
        F.greatest(x1, x2).alias("rx"), F.when(x1 < x2, y2).otherwise(y1).alias("ry"),
        F.when(x2 < x1, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sg"))
    s = F.lit(float(slab))
    e = e.withColumn("slab", F.explode(F.sequence(
        F.floor(F.col("lx") / s).cast("long"), (F.ceil(F.col("rx") / s) - 1).cast("long"))))
    xa = F.greatest(F.col("lx"), F.col("slab") * s)
    xb = F.least(F.col("rx"), (F.col("slab") + 1) * s)

    def interp(x):
        return (F.col("ly") + (F.col("ry") - F.col("ly")) * (x - F.col("lx"))
                / (F.col("rx") - F.col("lx")))

    e = e.select(key, "slab", xa.alias("xa"), xb.alias("xb"),
                 F.when(xa == F.col("lx"), F.col("ly")).otherwise(interp(xa)).alias("ya"),
                 F.when(xb == F.col("rx"), F.col("ry")).otherwise(interp(xb)).alias("yb"),
                 "sg")
    return e.where(F.col("xb") > F.col("xa"))


def _pair_integral(lo, hi, fl, fh, gl, gh):
    """integral_lo^hi min(f, g) dx for linear f, g given at both ends."""
    dl, dh = fl - gl, fh - gh
    ml, mh = F.least(fl, gl), F.least(fh, gh)
    straight = (hi - lo) * (ml + mh) / F.lit(2.0)
    t = dl / (dl - dh)
    xc = lo + t * (hi - lo)
    yc = fl + t * (fh - fl)
    bent = (xc - lo) * (ml + yc) / F.lit(2.0) + (hi - xc) * (yc + mh) / F.lit(2.0)
    return F.when(dl * dh >= 0, straight).otherwise(bent)


def overlay_area(a: DataFrame, a_key: str, a_rings: str, b: DataFrame, b_key: str,
                 b_rings: str, slab: float, cell: float, tolerance: float = 1e-12) -> DataFrame:
    """(a_key, b_key, area) of every pair whose overlap exceeds ``tolerance`` times
    the bounding box of the smaller polygon (so slivers count in any unit, and
    rounding noise does not).

    One row per polygon key on each side (dissolve multi-row features first);
    multi-part polygons and holes are rings of that one row.
    """
    pairs = bbox_pairs(a, a_key, a_rings, b, b_key, b_rings, cell)
    xmin, ymin, _, _ = G.bbox(a_rings)
    def box(df, k, rings, name):
        x0, y0, x1, y1 = G.bbox(rings)
        return df.select(F.col(k), ((x1 - x0) * (y1 - y0)).alias(name)).groupBy(k).agg(F.max(name).alias(name))

    origin = (a.select(F.col(a_key), xmin.alias("_ox"), ymin.alias("_oy"))
              .groupBy(a_key).agg(F.min("_ox").alias("_ox"), F.min("_oy").alias("_oy")))
    pa = edge_pieces(a, a_key, a_rings, slab).select(
        a_key, "slab", *[F.col(c).alias(f"a_{c}") for c in ("xa", "xb", "ya", "yb", "sg")])
    pb = edge_pieces(b, b_key, b_rings, slab).select(
        b_key, "slab", *[F.col(c).alias(f"b_{c}") for c in ("xa", "xb", "ya", "yb", "sg")])
    j = (pa.join(pairs, a_key).join(origin, a_key)
           .join(pb, [b_key, "slab"]))
    lo = F.greatest("a_xa", "b_xa")
    hi = F.least("a_xb", "b_xb")
    j = j.where(hi > lo)

    def at(p, x):
        xa, xb = F.col(f"{p}_xa"), F.col(f"{p}_xb")
        ya, yb = F.col(f"{p}_ya") - F.col("_oy"), F.col(f"{p}_yb") - F.col("_oy")
        return F.when(x == xa, ya).when(x == xb, yb) \
            .otherwise(ya + (yb - ya) * (x - xa) / (xb - xa))

    lo_l, hi_l = lo - F.col("_ox"), hi - F.col("_ox")
    val = _pair_integral(lo_l, hi_l, at("a", lo), at("a", hi), at("b", lo), at("b", hi))
    contrib = F.col("a_sg") * F.col("b_sg") * val
    res = j.groupBy(a_key, b_key).agg(F.sum(contrib).alias("area"))
    res = res.join(box(a, a_key, a_rings, "_ba"), a_key).join(box(b, b_key, b_rings, "_bb"), b_key)
    return res.where(F.col("area") > F.least("_ba", "_bb") * F.lit(tolerance)).select(a_key, b_key, "area")


# --- union area ---------------------------------------------------------------

#: Share of a unit to which coordinates are rounded: exact for those with up to 36 binary places.
UNION_GRID = 2.0 ** -36


def union_area(a: DataFrame, a_key: str, a_rings: str, b: DataFrame, b_key: str,
               b_rings: str, slab: float, cell: float, grid: float = UNION_GRID,
               layer: str | None = None) -> DataFrame:
    """(a_key, area): area of each A polygon covered by the union of B; with
    ``layer``, a column of B, (a_key, layer, area) by the union of each layer.

    The edges of an A polygon and of all B polygons near it are noded
    together; an edge bounds the covered region if both windings are above
    zero on one side only, and the area is the sum over those edges.  Nothing
    is grouped by polygon or slab: cells hold a bounded number of edges.
    ``slab`` is the width of the cells before crowded ones are split.
    """
    by = [a_key, *([layer] if layer else [])]
    key = F.struct(*by)
    pairs = bbox_pairs(a, a_key, a_rings, b, b_key, b_rings, cell)
    near = cut_lineage(b.select(b_key, b_rings, *by[1:]).join(pairs, b_key), "near-polygons")
    own = a.select(a_key, a_rings).join(near.select(*by).distinct(), a_key)
    ea = A.polygon_edges(own.withColumn("_key", key), "_key", a_rings, grid)
    eb = A.polygon_edges(near.withColumn("_key", key), "_key", b_rings, grid, a=0, b=1)
    width = 2.0 ** round(math.log2(slab / grid))
    e = A.noded(ea.unionByName(eb), width).where("ma <> 0 or mb <> 0")
    area = A.area_of(A.boundary(e, lambda wa, wb: f"{wa} > 0 and {wb} > 0", width), "_key", grid)
    return area.select(*[F.col(f"_key.{c}").alias(c) for c in by], "area")


def intersects_sliced(a: DataFrame, a_key: str, a_rings: str, b: DataFrame, b_key: str,
                      b_rings: str, slab: float, cell: float) -> DataFrame:
    """Intersecting polygon pairs for polygons of any size.

    Edge pieces of the two polygons meet only inside the same x-slab (equi
    join on pair + slab), so no polygon's edge list is ever compared whole.
    Containment uses a vertical ray from one vertex, which only crosses
    pieces of that vertex's slab.
    """
    pairs = bbox_pairs(a, a_key, a_rings, b, b_key, b_rings, cell)
    cols = ("xa", "xb", "ya", "yb")
    pa = indexed_pieces(a, a_key, a_rings, slab).select(a_key, "slab", *[F.col(c).alias(f"a_{c}") for c in cols])
    pb = indexed_pieces(b, b_key, b_rings, slab).select(b_key, "slab", *[F.col(c).alias(f"b_{c}") for c in cols])
    j = pa.join(pairs, a_key).join(pb, [b_key, "slab"])
    seg_a = "named_struct('x1', a_xa, 'y1', a_ya, 'x2', a_xb, 'y2', a_yb)"
    seg_b = "named_struct('x1', b_xa, 'y1', b_ya, 'x2', b_xb, 'y2', b_yb)"
    crossing = j.where(G.col(G.segments_cross_sql(seg_a, seg_b))).select(a_key, b_key)

    def vertex(df, key, rings):
        return df.select(F.col(key), G.col(f"element_at(element_at({rings}, 1), 1)").alias("v"))

    s = float(slab)

    def contains(inner, inner_key, inner_rings, outer_pieces, outer_key, p):
        v = vertex(inner, inner_key, inner_rings)
        v = v.withColumn("slab", F.floor(F.col("v.x") / F.lit(s)).cast("long"))
        k = pairs.join(v, inner_key).join(outer_pieces, [outer_key, "slab"])
        px, py = F.col("v.x"), F.col("v.y")
        xa, xb = F.col(f"{p}_xa"), F.col(f"{p}_xb")
        ya, yb = F.col(f"{p}_ya"), F.col(f"{p}_yb")
        y_at = ya + F.try_divide((yb - ya) * (px - xa), xb - xa)
        hit = (xa <= px) & (px < xb) & (y_at > py)
        return (k.groupBy(a_key, b_key).agg(F.count_if(hit).alias("_c"))
                .where(F.col("_c") % 2 == 1).select(a_key, b_key))

    a_in_b = contains(a, a_key, a_rings, pb, b_key, "b")
    b_in_a = contains(b, b_key, b_rings, pa, a_key, "a")
    return crossing.unionByName(a_in_b).unionByName(b_in_a).distinct()


def indexed_pieces(df: DataFrame, key: str, rings: str, slab: float) -> DataFrame:
    """Edge pieces for *topological* tests: ring index ``ri``, edge index
    ``ei`` and ring size ``rn`` are kept, vertical edges are kept, and slabs
    are closed ranges (a point on a slab border belongs to both slabs), so
    two segments that meet anywhere always share a slab."""
    r = df.select(F.col(key), F.posexplode(F.col(rings)).alias("ri", "ring"))
    e = r.select(key, "ri", F.size("ring").alias("rn"),
                 F.posexplode(G.col(G.ring_edges_sql("ring"))).alias("ei", "e"))
    x1, y1, x2, y2 = F.col("e.x1"), F.col("e.y1"), F.col("e.x2"), F.col("e.y2")
    e = e.select(
        key, "ri", "ei", "rn",
        F.least(x1, x2).alias("lx"), F.when(x1 < x2, y1).otherwise(y2).alias("ly"),
        F.greatest(x1, x2).alias("rx"), F.when(x1 < x2, y2).otherwise(y1).alias("ry"))
    s = F.lit(float(slab))
    e = e.withColumn("slab", F.explode(F.sequence(
        (F.ceil(F.col("lx") / s) - 1).cast("long"), F.floor(F.col("rx") / s).cast("long"))))
    xa = F.greatest(F.col("lx"), F.col("slab") * s)
    xb = F.least(F.col("rx"), (F.col("slab") + 1) * s)

    def interp(x):
        return (F.col("ly") + (F.col("ry") - F.col("ly")) * (x - F.col("lx"))
                / (F.col("rx") - F.col("lx")))

    e = e.select(key, "ri", "ei", "rn", "slab", xa.alias("xa"), xb.alias("xb"),
                 F.when(xa == F.col("lx"), F.col("ly")).otherwise(interp(xa)).alias("ya"),
                 F.when(xb == F.col("rx"), F.col("ry")).otherwise(interp(xb)).alias("yb"))
    return e.where(F.col("xb") >= F.col("xa"))


def self_crossing(df: DataFrame, key: str, rings: str, slab: float) -> DataFrame:
    """Keys of polygons whose boundary meets itself anywhere except where
    consecutive edges share their vertex (OGC simple/valid ring test, minus
    vertical-only edges).  Pieces meet only within their slab."""
    p = indexed_pieces(df, key, rings, slab)
    a = p.select(*[F.col(c).alias(f"a_{c}") for c in p.columns])
    b = p.select(*[F.col(c).alias(f"b_{c}") for c in p.columns])
    j = a.join(b, (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("a_slab") == F.col("b_slab")))
    same_ring = F.col("a_ri") == F.col("b_ri")
    later = (F.col("a_ri") < F.col("b_ri")) | (same_ring & (F.col("a_ei") < F.col("b_ei")))
    adjacent = same_ring & (((F.col("b_ei") - F.col("a_ei")) == 1)
                            | ((F.col("a_ei") == 0) & (F.col("b_ei") == F.col("a_rn") - 1)))
    seg_a = "named_struct('x1', a_xa, 'y1', a_ya, 'x2', a_xb, 'y2', a_yb)"
    seg_b = "named_struct('x1', b_xa, 'y1', b_ya, 'x2', b_xb, 'y2', b_yb)"
    hit = j.where(later & ~adjacent & G.col(G.segments_cross_sql(seg_a, seg_b)))
    return hit.select(F.col(f"a_{key}").alias(key)).distinct()
