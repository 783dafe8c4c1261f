"""Dissolve (group polygons by a key) and outlines of groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrangement as A
from .sizing import cut_lineage


def dissolve(df: DataFrame, by: str, sums: Sequence[str], firsts: Sequence[str],
             order: str, rings: str = "rings") -> DataFrame:
    """Group features by ``by``: sums, deterministic 'first' (the value of
    the row with the smallest ``order``), and all rings as one multi-ring.

    Merged geometry keeps every part; shared borders are not removed here
    (see :func:`outline_edges`).  Areas stay additive.
    """
    aggs = [F.sum(c).alias(c) for c in sums]
    aggs += [F.min_by(F.col(c), F.col(order)).alias(c) for c in firsts]
    aggs.append(F.flatten(F.collect_list(rings)).alias(rings))
    return df.groupBy(by).agg(*aggs)


def outline_boundary(df: DataFrame, by: str, rings: str = "rings", digits: int = 6) -> DataFrame:
    """Directed boundary edges (_k, x1, y1, x2, y2) of the union of each group's
    polygons, in units of the last digit.

    Edges are noded first, so borders shared in part, overlaps and polygons
    inside others dissolve too; an edge stays where the sum of windings turns
    from or to zero."""
    e = A.polygon_edges(df, by, rings, 10.0 ** -digits)
    return cut_lineage(A.boundary(A.noded(e).where("ma <> 0"), lambda w, _: f"{w} > 0"), "outline")


def outline_edges(df: DataFrame, by: str, rings: str = "rings", digits: int = 6) -> DataFrame:
    """Boundary edges of the union of each group's polygons, from the smaller end."""
    return undirected(outline_boundary(df, by, rings, digits), by, digits)


def undirected(bound: DataFrame, by: str, digits: int = 6) -> DataFrame:
    u = A.merged(bound.withColumns({"ma": F.lit(1).cast("long"), "mb": F.lit(0).cast("long")}))
    return u.select(F.col("_k").alias(by), *[(F.col(c) / F.lit(10.0 ** digits)).alias(c) for c in A.ENDS])


def _simplify(pts: np.ndarray, tol: float) -> np.ndarray:
    """Douglas-Peucker on an open polyline (iterative, numpy distances)."""
    if len(pts) < 3 or tol <= 0:
        return pts
    keep = np.zeros(len(pts), dtype=bool)
    keep[0] = keep[-1] = True
    stack = [(0, len(pts) - 1)]
    while stack:
        i, j = stack.pop()
        if j <= i + 1:
            continue
        a, b = pts[i], pts[j]
        seg = b - a
        norm = np.hypot(*seg)
        mid = pts[i + 1:j]
        if norm == 0:
            d = np.hypot(*(mid - a).T)
        else:
            d = np.abs(seg[0] * (mid[:, 1] - a[1]) - seg[1] * (mid[:, 0] - a[0])) / norm
        k = int(np.argmax(d))
        if d[k] > tol:
            keep[i + 1 + k] = True
            stack.append((i, i + 1 + k))
            stack.append((i + 1 + k, j))
    return pts[keep]


def simplify_ring(ring: np.ndarray, tol: float) -> np.ndarray:
    """Simplify a closed ring (open vertex list): split at the vertex
    farthest from the first one, simplify both halves."""
    if len(ring) <= 3 or tol <= 0:
        return ring
    far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    a = _simplify(ring[:far + 1], tol)
    b = _simplify(np.vstack([ring[far:], ring[:1]]), tol)
    out = np.vstack([a[:-1], b[:-1]])
    return out if len(out) >= 3 else ring


def ring_area(pts: np.ndarray) -> float:
    x, y = (pts - pts[0]).T
    return 0.5 * float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))


def _simplified(tolerance: float):
    """A ring a row: simplified, with its area and perimeter."""
    def run(batches):
        for pdf in batches:
            out = [simplify_ring(np.array([(p["x"], p["y"]) for p in r], dtype=float), tolerance) for r in pdf["ring"]]
            pdf["area"] = [ring_area(p) for p in out]
            pdf["perimeter"] = [float(np.sum(np.hypot(*(np.roll(p, -1, axis=0) - p).T))) for p in out]
            pdf["ring"] = [[{"x": float(a), "y": float(b)} for a, b in p] for p in out]
            yield pdf
    return run


def outline_rings(edges: DataFrame, by: str, tolerance: float = 0.0, digits: int = 6) -> DataFrame:
    """:func:`boundary_rings` of outline edges (from :func:`outline_edges`), which have no direction."""
    e = A.polygon_edges(edges.withColumn("_r", F.expr("array(array(struct(x1 as x, y1 as y), struct(x2 as x, y2 as y)))")), by, "_r", 10.0 ** -digits)
    bound = A.boundary(A.merged(e).withColumn("ma", F.lit(1).cast("long")), lambda w, _: f"{w} % 2 <> 0")
    return boundary_rings(bound, by, tolerance, digits)


def boundary_rings(bound: DataFrame, by: str, tolerance: float = 0.0, digits: int = 6) -> DataFrame:
    """A boundary (from :func:`outline_boundary`) as closed rings, simplified
    with Douglas-Peucker at ``tolerance``, with signed area (holes are negative)
    and perimeter of the simplified rings; ``ring_id`` counts the rings of a
    group, larger shells first, holes behind their shell.

    Rings are found by pointer doubling over all edges; no task holds a group.
    Only a single ring's vertices are gathered in one row, to simplify it."""
    v = cut_lineage(A.rings(bound), "rings")
    m = A.nested(v, cut_lineage(A.ring_measures(v), "ring-measures"))
    sizes = m.where("area > 0").select(F.col("_ring").alias("_shell"), F.col("area").alias("_size"))
    order = Window.partitionBy("_k").orderBy(F.col("_size").desc(), "_shell", F.col("area") < 0, F.abs("area").desc(), "_ring")
    numbered = m.join(sizes, "_shell").select("_ring", (F.row_number().over(order) - 1).cast("long").alias("ring_id"))
    rows = A.ring_rows(v, m, 10.0 ** -digits).join(numbered, "_ring").select(
        F.col("_k").alias(by), "ring_id", "area", F.lit(0.0).alias("perimeter"), "ring")
    return rows.mapInPandas(_simplified(tolerance), rows.schema)
