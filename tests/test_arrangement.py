"""Arrangements against plain Python: noding, windings, ring repair, outlines, bounded cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from townrisk.operators import arrangement as A
from townrisk.operators.dissolve import boundary_rings, outline_boundary
from townrisk.operators.overlay import union_area

RINGS = "array<array<struct<x:double,y:double>>>"


def frame(spark, polys, extra=""):
    rows = [(k, *more, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, *more, rings in polys]
    return spark.createDataFrame(rows, f"k long,{extra} rings {RINGS}")


def strips(edges, inside):
    """Area where ``inside`` holds for the windings of stacked edges, strip by strip."""
    xs = {x for e in edges for x in (e[0], e[2])}
    for i, (ax, ay, bx, by, _) in enumerate(edges):
        for cx, cy, dx, dy, _ in edges[:i]:
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if den:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
                u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
                if 0 <= t <= 1 and 0 <= u <= 1:
                    xs.add(ax + t * (bx - ax))
    xs, total = sorted(xs), 0.0
    for lo, hi in zip(xs, xs[1:], strict=False):
        mid, w = (lo + hi) / 2, {}
        stack = sorted((y1 + (mid - x1) * (y2 - y1) / (x2 - x1), 1 if x2 > x1 else -1, o)
                       for x1, y1, x2, y2, o in edges if min(x1, x2) < mid < max(x1, x2))
        for (y, s, o), above in zip(stack, [*stack[1:], None], strict=False):
            w[o] = w.get(o, 0) + s
            if above and inside(w):
                total += (above[0] - y) * (hi - lo)
    return total


def edges_of(rings, owner=0):
    return [(*r[i], *r[(i + 1) % len(r)], owner) for r in rings for i in range(len(r))]


def ccw(r):
    return r if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) > 0 else r[::-1]


def star(rng, cx, cy, size, n):
    return [(cx + size * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), cy + size * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


CROSSED = {
    0: [(0, 0), (10, 10), (10, 0), (0, 10)],
    1: [(0, 0), (10, 0), (10, 10), (0, 10)],
    2: [(0, 6), (12, 6), (2, 14), (6, 0), (10, 14)],
    3: [(0, 0), (10, 0), (10, 10), (4, 10), (4, 4), (14, 4), (14, 14), (0, 14)],
    4: [(0, 0), (12, 0), (12, 12), (0, 12), (0, 6), (4, 6), (4, 8), (8, 8), (8, 4), (4, 4), (4, 6), (0, 6)],
    5: [(0, 0), (4, 0), (8, 0), (2, 0)],                                      # no area at all
    6: [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0), (9, 0), (9, 9), (0, 9)],      # twice around: even everywhere
    7: [(0, 0), (6, 0), (6, 0), (6, 6), (3, 0), (0, 6)],                      # a corner that touches an edge
}


def test_repair_of_odd_and_random_rings(spark):
    rng = random.Random(3)
    shapes = dict(CROSSED) | {k: [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.randrange(3, 25))] for k in range(10, 26)}
    got = A.repaired(frame(spark, [(k, [r]) for k, r in shapes.items()]), "k", "rings", 1e-6).collect()
    rings = {}
    for r in got:
        rings.setdefault(r.k, []).append(r)
    for k, shape in shapes.items():
        want = strips(edges_of([shape]), lambda w: w[0] % 2)
        assert abs(sum(r.area for r in rings.get(k, [])) - want) < 1e-3, k
    assert 5 not in rings and 6 not in rings
    shape_of = {k: (sum(r.area > 0 for r in rings[k]), sum(r.area < 0 for r in rings[k])) for k in (0, 1, 2, 3, 4, 7)}
    assert shape_of == {0: (2, 0), 1: (1, 0), 2: (5, 0), 3: (1, 1), 4: (1, 1), 7: (2, 0)}
    for k, rs in rings.items():
        for r in rs:
            points = [(p.x, p.y) for p in r.ring]
            assert len(points) == len(set(points)) >= 3, k                     # every ring is simple at its ends
            assert r._shell == r._ring or r.area < 0
    again = spark.createDataFrame([(r.k, [r.ring]) for r in got], f"k long, rings {RINGS}")
    assert A.flawed(A.polygon_edges(again, "k", "rings", 1e-6)).count() == 0   # nothing crosses any more
    assert A.flawed(A.polygon_edges(frame(spark, [(0, [CROSSED[0]]), (1, [CROSSED[1]])]), "k", "rings", 1e-6)).collect()[0]._k == 0


def test_union_area_by_layer(spark):
    rng = random.Random(5)
    a = [(k, [ccw(star(rng, 20 * k, 0, 14, 9))]) for k in range(4)]
    b = [(k, rng.randrange(2), [ccw(star(rng, rng.uniform(-10, 70), rng.uniform(-10, 10), 6, 5))]) for k in range(60)]
    got = union_area(frame(spark, a).withColumnRenamed("k", "zone"), "zone", "rings", frame(spark, b, " kind long,"), "k", "rings",
                     slab=4.0, cell=8.0, layer="kind")
    got = {(r.zone, r.kind): r.area for r in got.collect()}
    for k, rings in a:
        for kind in (0, 1):
            e = edges_of(rings, "a") + [x for _, o, rs in b if o == kind for x in edges_of(rs, "b")]
            want = strips(e, lambda w: w.get("a", 0) > 0 and w.get("b", 0) > 0)
            assert abs(got.get((k, kind), 0.0) - want) < 1e-7


def test_outline_of_overlaps_and_partly_shared_borders(spark):
    squares = [(0, [[(0, 0), (4, 0), (4, 4), (0, 4)]]), (0, [[(4, 1), (8, 1), (8, 6), (4, 6)]]),            # a border shared in part
               (0, [[(2, 3), (6, 3), (6, 8), (2, 8)]]), (0, [[(3, 3.5), (5, 3.5), (5, 5), (3, 5)]]),         # overlap, and one inside
               (1, [[(0, 0), (9, 0), (9, 3), (0, 3)]]), (1, [[(0, 6), (9, 6), (9, 9), (0, 9)]]),             # a frame around a hole
               (1, [[(0, 3), (3, 3), (3, 6), (0, 6)]]), (1, [[(6, 3), (9, 3), (9, 6), (6, 6)]])]
    got = boundary_rings(outline_boundary(frame(spark, squares), "k"), "k", 1e-9).collect()
    for k in (0, 1):
        e = [x for o, rs in squares if o == k for x in edges_of(rs)]
        assert abs(sum(r.area for r in got if r.k == k) - strips(e, lambda w: w[0] > 0)) < 1e-9
    assert sorted((r.k, r.ring_id, round(r.area, 9), len(r.ring)) for r in got if r.k == 1) == [(1, 0, 81.0, 4), (1, 1, -9.0, 4)]
    assert {(p.x, p.y) for r in got if r.k == 0 for p in r.ring} == {
        (0, 0), (4, 0), (4, 1), (8, 1), (8, 6), (6, 6), (6, 8), (2, 8), (2, 4), (0, 4)}


@pytest.mark.parametrize("limit", [8, 48])
def test_points_in_a_ring_of_many_vertices(spark, limit):
    rng = random.Random(limit)
    n = 3000 if limit == 48 else 500
    ring = star(rng, 0, 0, 50, n)
    e = A.polygon_edges(frame(spark, [(7, [ring])]), "k", "rings")
    cells, deepest = A.cover(e, 32.0, limit, inside=True)
    assert deepest > 0 and cells.agg(F.max(F.size("edges"))).first()[0] <= limit
    pts = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(800)] + [(800 + i, *ring[i]) for i in range(20)]
    got = A.points_in(spark.createDataFrame(pts, "i long, x double, y double"), (cells, deepest), 32.0, "x", "y", "k").collect()
    es = [x[:4] for x in edges_of([ring])]
    want = {i for i, x, y in pts if sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in es) % 2}
    assert len(got) == len({r.i for r in got}) and {r.i for r in got if r.i < 800} == {i for i in want if i < 800}


def test_corners_on_cell_borders(spark):
    """Ends, level and upright edges on the cells' borders, and points on them, as the plain rule has it."""
    rng = random.Random(9)
    shapes = {k: ccw([(x * 2.0, y * 2.0) for x, y in [(0, 0), (rng.randrange(2, 9), rng.randrange(0, 2)), (9, rng.randrange(2, 9)), (4, rng.randrange(3, 9)), (0, 9)]])
              for k in range(12)}
    pts = [(i, rng.randrange(-2, 40) / 2.0, rng.randrange(-2, 40) / 2.0) for i in range(300)]
    e = A.polygon_edges(frame(spark, [(k, [r]) for k, r in shapes.items()]), "k", "rings")
    for limit in (2, 48):
        cover = A.cover(e, 4.0, limit, depth=4, inside=True)
        got = {(r.i, r.k) for r in A.points_in(spark.createDataFrame(pts, "i long, x double, y double"), cover, 4.0, "x", "y", "k").collect()}
        want = {(i, k) for i, x, y in pts for k, r in shapes.items()
                if sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2, _ in edges_of([r])) % 2}
        assert got == want


def test_a_crowd_of_pieces_stays_within_the_limit(spark):
    """20,000 pieces of one zone in one slab: no cell holds more than the limit, nothing is grouped in Python."""
    e = spark.range(20000).selectExpr("0L as _k", "double(id % 40) as x1", "double(pmod(id * 7919, 20011)) as y1",
                                      "double(id % 40 + 1) as x2", "double(pmod(id * 7919 + id % 7, 20011)) as y2", "1L as ma", "0L as mb")
    cells, _ = A.cover(e, 64.0, 48, corners=False)
    assert cells.agg(F.max(F.size("edges"))).first()[0] <= 48
    assert "Python" not in cells._jdf.queryExecution().executedPlan().toString()


def spikes(n):
    """A ring of n long edges side by side, around (50, 50)."""
    at = [(50 + (30 + 10 * (i * 7919 % 101) / 101) * math.cos(2 * math.pi * i / n), 50 + (30 + 10 * (i * 7919 % 101) / 101) * math.sin(2 * math.pi * i / n))
          for i in range(n)]
    return [(*a, *b) for a, b in zip(at, [*at[1:], at[0]], strict=True)]


def ring_of(spark, edges, key=0):
    return spark.createDataFrame([(key, *e, 1, 0) for e in edges], "_k long, x1 double, y1 double, x2 double, y2 double, ma long, mb long")


@pytest.mark.parametrize("limit, most", [(A.CROWD, A.POINTS), (500, 40)])
def test_points_in_crowded_cells(spark, limit, most):
    rnd = random.Random(3)
    star = [(90 * rnd.random(), 90 * rnd.random()) for _ in range(60)]  # crosses itself everywhere
    star = [(*a, *b) for a, b in zip(star, [*star[1:], star[0]], strict=True)]
    rings = {0: spikes(3000), 7: star, 8: [(8.0, 8.0, 16.0, 8.0), (16.0, 8.0, 16.0, 16.0), (16.0, 16.0, 8.0, 16.0), (8.0, 16.0, 8.0, 8.0)]}
    pts = [(i, 100 * rnd.random(), 100 * rnd.random()) for i in range(3000)] + [(3000 + i, 8.0 + i % 9, 8.0 + i // 9) for i in range(81)]
    pts += [(4000, 50.0, 50.0), (4001, -500.0, 3.0)]
    e = ring_of(spark, rings[0]).unionByName(ring_of(spark, rings[7], 7)).unionByName(ring_of(spark, rings[8], 8))
    p = spark.createDataFrame(pts, "i long, x double, y double")
    got = {(r.i, r.k) for r in A.points_in_crowded(p, A.cover(e, 8.0, limit, inside=True, gather=False), 8.0, "x", "y", "k", most).collect()}
    want = {(i, k) for i, x, y in pts for k, es in rings.items()
            if sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in es) % 2}
    assert got == want
    assert got == {(r.i, r.k) for r in A.points_in(p, A.cover(e, 8.0, inside=True), 8.0, "x", "y", "k").collect()}


def test_rows_of_side_by_side_edges_grow_with_the_edges(spark):
    few, many = (A.cover(ring_of(spark, spikes(n)), 8.0, A.CROWD, inside=True, gather=False)[0].where("x1 is not null").count() for n in (2000, 8000))
    assert many < 4.4 * few  # by the square with cells of few edges
