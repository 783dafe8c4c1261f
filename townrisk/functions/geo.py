"""Planar geometry as Spark column expressions.

Polygons are ``rings: array<array<struct<x: double, y: double>>>`` (outer
rings counter-clockwise, holes clockwise, ring not explicitly closed).
Edges are ``struct<x1, y1, x2, y2>``.  Everything here is a higher-order
function over arrays, so it stays JVM-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double>"
EDGE = "struct<x1: double, y1: double, x2: double, y2: double>"

# Each helper returns SQL text over SQL text arguments (column names, struct
# fields or lambda variables) so a whole geometric expression is parsed by
# the JVM in one call; ``col`` wraps the text as a Column.


def col(sql: str) -> Column:
    return F.expr(sql)


def ring_edges_sql(ring: str) -> str:
    """Closed edge list of one ring (last vertex joins the first)."""
    nxt = f"element_at({ring}, (i + 1) % size({ring}) + 1)"
    return (f"transform({ring}, (p, i) -> named_struct('x1', p.x, 'y1', p.y, "
            f"'x2', {nxt}.x, 'y2', {nxt}.y))")


def poly_edges_sql(rings: str) -> str:
    """All edges of a polygon (every ring)."""
    return f"flatten(transform({rings}, rr -> {ring_edges_sql('rr')}))"


def poly_edges(rings: str) -> Column:
    return col(poly_edges_sql(rings))


def bbox(rings: str) -> tuple[Column, Column, Column, Column]:
    pts = f"flatten({rings})"
    return (col(f"array_min(transform({pts}, q -> q.x))"),
            col(f"array_min(transform({pts}, q -> q.y))"),
            col(f"array_max(transform({pts}, q -> q.x))"),
            col(f"array_max(transform({pts}, q -> q.y))"))


def _origin(rings: str) -> tuple[str, str]:
    o = f"element_at(element_at({rings}, 1), 1)"
    return f"{o}.x", f"{o}.y"


def _cross(ox: str, oy: str) -> str:
    return f"((e.x1 - {ox}) * (e.y2 - {oy}) - (e.x2 - {ox}) * (e.y1 - {oy}))"


def signed_area_sql(rings: str) -> str:
    """Shoelace area (holes negative) about the first vertex, for precision."""
    ox, oy = _origin(rings)
    return f"(aggregate({poly_edges_sql(rings)}, 0D, (acc, e) -> acc + {_cross(ox, oy)}) / 2D)"


def area(rings: str) -> Column:
    return col(f"abs({signed_area_sql(rings)})")


def centroid(rings: str) -> tuple[Column, Column]:
    """Area-weighted centroid (x, y)."""
    ox, oy = _origin(rings)
    edges = poly_edges_sql(rings)
    cr = _cross(ox, oy)
    sx = f"aggregate({edges}, 0D, (acc, e) -> acc + (e.x1 - {ox} + e.x2 - {ox}) * {cr})"
    sy = f"aggregate({edges}, 0D, (acc, e) -> acc + (e.y1 - {oy} + e.y2 - {oy}) * {cr})"
    a6 = f"(6D * {signed_area_sql(rings)})"
    return col(f"{ox} + {sx} / {a6}"), col(f"{oy} + {sy} / {a6}")


def crossings_sql(px: str, py: str, edges: str) -> str:
    """Edges a ray from (px, py) towards +x crosses (half-open rule on y)."""
    return (f"size(filter({edges}, e -> ((e.y1 > {py}) != (e.y2 > {py})) AND "
            f"({px} < try_divide((e.x2 - e.x1) * ({py} - e.y1), e.y2 - e.y1) + e.x1)))")


def inside_sql(px: str, py: str, edges: str) -> str:
    """Even-odd point-in-polygon test."""
    return f"({crossings_sql(px, py, edges)} % 2 = 1)"


def inside(px: str, py: str, edges: str) -> Column:
    return col(inside_sql(px, py, edges))


def segments_cross_sql(a: str, b: str) -> str:
    """Closed segment intersection test (touching counts)."""
    def pt(s, k):
        return {"x": f"{s}.x{k}", "y": f"{s}.y{k}"}
    def ori(p, q, r):
        return f"signum(({q['x']} - {p['x']}) * ({r['y']} - {p['y']}) - ({q['y']} - {p['y']}) * ({r['x']} - {p['x']}))"
    A1, A2, B1, B2 = pt(a, 1), pt(a, 2), pt(b, 1), pt(b, 2)
    boxes = (f"least({a}.x1, {a}.x2) <= greatest({b}.x1, {b}.x2) AND "
             f"least({b}.x1, {b}.x2) <= greatest({a}.x1, {a}.x2) AND "
             f"least({a}.y1, {a}.y2) <= greatest({b}.y1, {b}.y2) AND "
             f"least({b}.y1, {b}.y2) <= greatest({a}.y1, {a}.y2)")
    return (f"({boxes} AND {ori(A1, A2, B1)} * {ori(A1, A2, B2)} <= 0 AND "
            f"{ori(B1, B2, A1)} * {ori(B1, B2, A2)} <= 0)")


def snap_sql(rings: str, digits: int = 6) -> str:
    """Round coordinates and drop consecutive duplicate vertices."""
    r = f"transform(sr, q -> named_struct('x', round(q.x, {digits}), 'y', round(q.y, {digits})))"
    prev = f"element_at({r}, (j + size(sr) - 1) % size(sr) + 1)"
    keep = (f"transform(filter(transform({r}, (q, j) -> named_struct('p', q, 'k', q != {prev})), "
            f"z -> z.k OR size(sr) = 1), z -> z.p)")
    return f"transform({rings}, sr -> {keep})"


def snap(rings: str, digits: int = 6) -> Column:
    return col(snap_sql(rings, digits))


# ---------------------------------------------------------------------------
# Projections.  FIXED VALUES: GRS80 ellipsoid, plane rectangular zone IX
# (origin 36 N, 139 deg 50 min E, scale 0.9999), spherical web mercator.
# ---------------------------------------------------------------------------

GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
ZONE9_LAT0 = 36.0
ZONE9_LON0 = 139.0 + 50.0 / 60.0
ZONE9_K0 = 0.9999

_n = GRS80_F / (2 - GRS80_F)
_A = GRS80_A / (1 + _n) * (1 + _n ** 2 / 4 + _n ** 4 / 64)
# Krueger series coefficients to fourth order in n.
_ALPHA = (
    _n / 2 - 2 * _n ** 2 / 3 + 5 * _n ** 3 / 16 + 41 * _n ** 4 / 180,
    13 * _n ** 2 / 48 - 3 * _n ** 3 / 5 + 557 * _n ** 4 / 1440,
    61 * _n ** 3 / 240 - 103 * _n ** 4 / 140,
    49561 * _n ** 4 / 161280,
)
_BETA = (
    _n / 2 - 2 * _n ** 2 / 3 + 37 * _n ** 3 / 96 - _n ** 4 / 360,
    _n ** 2 / 48 + _n ** 3 / 15 - 437 * _n ** 4 / 1440,
    17 * _n ** 3 / 480 - 37 * _n ** 4 / 840,
    4397 * _n ** 4 / 161280,
)
_DELTA = (
    2 * _n - 2 * _n ** 2 / 3 - 2 * _n ** 3 + 116 * _n ** 4 / 45,
    7 * _n ** 2 / 3 - 8 * _n ** 3 / 5 - 227 * _n ** 4 / 45,
    56 * _n ** 3 / 15 - 136 * _n ** 4 / 35,
    4279 * _n ** 4 / 630,
)
_E2N = 2 * math.sqrt(_n) / (1 + _n)


def _xi0() -> float:
    phi = math.radians(ZONE9_LAT0)
    t = math.sinh(math.atanh(math.sin(phi)) - _E2N * math.atanh(_E2N * math.sin(phi)))
    xi = math.atan(t)
    return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(_ALPHA))


_S0 = ZONE9_K0 * _A * _xi0()


def _atanh(x: str) -> str:
    return f"(0.5D * ln((1D + {x}) / (1D - {x})))"


def with_plane_zone9(df, lon: str, lat: str, x_out: str, y_out: str):
    """Add plane zone IX metres (easting ``x_out``, northing ``y_out``) for
    geographic degrees; intermediate terms are their own columns so each
    is computed once and the generated code stays small."""
    e2n = repr(_E2N)
    df = df.withColumn("_tm_s", col(f"sin(radians({lat}))")) \
           .withColumn("_tm_l", col(f"radians({lon}) - {math.radians(ZONE9_LON0)!r}"))
    df = df.withColumn("_tm_t", col(f"sinh({_atanh('_tm_s')} - {e2n} * {_atanh(e2n + ' * _tm_s')})"))
    df = df.withColumn("_tm_xi", col("atan(_tm_t / cos(_tm_l))")) \
           .withColumn("_tm_eta", col(f"{_atanh('sin(_tm_l) / sqrt(1D + _tm_t * _tm_t)')}"))
    xs = " + ".join(f"{a!r} * cos({2 * j}D * _tm_xi) * sinh({2 * j}D * _tm_eta)"
                    for j, a in enumerate(_ALPHA, start=1))
    ys = " + ".join(f"{a!r} * sin({2 * j}D * _tm_xi) * cosh({2 * j}D * _tm_eta)"
                    for j, a in enumerate(_ALPHA, start=1))
    k = repr(ZONE9_K0 * _A)
    return (df.withColumn(x_out, col(f"{k} * (_tm_eta + {xs})"))
              .withColumn(y_out, col(f"{k} * (_tm_xi + {ys}) - {_S0!r}"))
              .drop("_tm_s", "_tm_l", "_tm_t", "_tm_xi", "_tm_eta"))


def with_lonlat_zone9(df, x: str, y: str, lon_out: str, lat_out: str):
    """Add geographic degrees for plane zone IX metres (inverse series)."""
    k = repr(ZONE9_K0 * _A)
    df = df.withColumn("_ti_xi", col(f"({y} + {_S0!r}) / {k}")) \
           .withColumn("_ti_eta", col(f"{x} / {k}"))
    xp = " - ".join(["_ti_xi"] + [f"{b!r} * sin({2 * j}D * _ti_xi) * cosh({2 * j}D * _ti_eta)"
                                  for j, b in enumerate(_BETA, start=1)])
    ep = " - ".join(["_ti_eta"] + [f"{b!r} * cos({2 * j}D * _ti_xi) * sinh({2 * j}D * _ti_eta)"
                                   for j, b in enumerate(_BETA, start=1)])
    df = df.withColumn("_ti_xp", col(xp)).withColumn("_ti_ep", col(ep))
    df = df.withColumn("_ti_chi", col("asin(sin(_ti_xp) / cosh(_ti_ep))"))
    phi = " + ".join(["_ti_chi"] + [f"{d!r} * sin({2 * j}D * _ti_chi)"
                                    for j, d in enumerate(_DELTA, start=1)])
    lam = f"{math.radians(ZONE9_LON0)!r} + atan(sinh(_ti_ep) / cos(_ti_xp))"
    return (df.withColumn(lon_out, col(f"degrees({lam})"))
              .withColumn(lat_out, col(f"degrees({phi})"))
              .drop("_ti_xi", "_ti_eta", "_ti_xp", "_ti_ep", "_ti_chi"))


def to_web_mercator(lon: str, lat: str) -> tuple[Column, Column]:
    r = repr(GRS80_A)
    return (col(f"{r} * radians({lon})"),
            col(f"{r} * ln(tan({math.pi / 4!r} + radians({lat}) / 2D))"))


def plane_zone9_sql(lon: str, lat: str) -> tuple[str, str]:
    """Forward zone IX projection as SQL text (for use inside lambdas)."""
    e2n = repr(_E2N)
    s = f"sin(radians({lat}))"
    t = f"sinh({_atanh(s)} - {e2n} * {_atanh(e2n + ' * ' + s)})"
    lam = f"(radians({lon}) - {math.radians(ZONE9_LON0)!r})"
    xi = f"atan({t} / cos({lam}))"
    eta = _atanh(f"sin({lam}) / sqrt(1D + {t} * {t})")
    xs = " + ".join(f"{a!r} * cos({2 * j}D * {xi}) * sinh({2 * j}D * {eta})"
                    for j, a in enumerate(_ALPHA, start=1))
    ys = " + ".join(f"{a!r} * sin({2 * j}D * {xi}) * cosh({2 * j}D * {eta})"
                    for j, a in enumerate(_ALPHA, start=1))
    k = repr(ZONE9_K0 * _A)
    return f"({k} * ({eta} + {xs}))", f"({k} * ({xi} + {ys}) - {_S0!r})"


def rings_to_plane(rings: str) -> Column:
    """Every vertex of a polygon from degrees to zone IX metres, in place
    (higher-order function over the rings: no shuffle, no regrouping)."""
    x, y = plane_zone9_sql("v.x", "v.y")
    return col(f"transform({rings}, rg -> transform(rg, v -> named_struct('x', {x}, 'y', {y})))")


def _ring_area_sql(ring: str) -> str:
    o = f"element_at({ring}, 1)"
    return (f"(aggregate({ring_edges_sql(ring)}, 0D, (acc, e) -> acc + "
            f"((e.x1 - {o}.x) * (e.y2 - {o}.y) - (e.x2 - {o}.x) * (e.y1 - {o}.y))) / 2D)")


def clean_rings_sql(rings: str) -> str:
    """Ingest hygiene: drop consecutive duplicate vertices and a repeated
    closing vertex, then orient the first ring counter-clockwise and every
    further ring (holes) clockwise."""
    unclosed = _open_rings_sql(rings)
    a = _ring_area_sql("ur")
    return (f"transform({unclosed}, (ur, ri) -> CASE WHEN (ri = 0 AND {a} < 0) OR (ri > 0 AND {a} > 0) "
            f"THEN reverse(ur) ELSE ur END)")


def clean_parts_sql(parts: str) -> str:
    """:func:`clean_rings_sql` for each part of a multi-part polygon; all
    rings in one list, holes behind their own outer ring."""
    return f"flatten(transform({parts}, pt -> {clean_rings_sql('pt')}))"


def clean_signed_rings_sql(rings: str) -> str:
    """The same where only ring direction tells parts from holes: rings that
    turn like the first one are outer rings, the others holes."""
    unclosed = _open_rings_sql(rings)
    first = _ring_area_sql(f"element_at({unclosed}, 1)")
    return f"CASE WHEN size({rings}) > 0 AND {first} < 0 THEN transform({unclosed}, ur -> reverse(ur)) ELSE {unclosed} END"


def geometry_sql(rings: str) -> str:
    """GeoJSON geometry of oriented rings: closed, a Polygon for one outer
    ring and a MultiPolygon for several."""
    closed = f"transform({rings}, gr -> concat(gr, slice(gr, 1, 1)))"
    xy = f"transform({closed}, gr -> transform(gr, p -> array(p.x, p.y)))"
    turn = ("aggregate(sequence(1, size(r) - 1), 0D, (acc, i) -> acc + (element_at(r, i)[0] - r[0][0]) * (element_at(r, i + 1)[1] - r[0][1]) "
            "- (element_at(r, i + 1)[0] - r[0][0]) * (element_at(r, i)[1] - r[0][1]))")
    parts = (f"aggregate({xy}, cast(array() as array<array<array<array<double>>>>), (acc, r) -> CASE WHEN size(acc) = 0 OR {turn} >= 0 "
             "THEN concat(acc, array(array(r))) ELSE concat(slice(acc, 1, size(acc) - 1), array(concat(element_at(acc, -1), array(r)))) END)")
    return (f"transform(array({parts}), ps -> CASE WHEN size(ps) = 1 THEN to_json(named_struct('type', 'Polygon', 'coordinates', ps[0])) "
            "ELSE to_json(named_struct('type', 'MultiPolygon', 'coordinates', ps)) END)[0]")


def _open_rings_sql(rings: str) -> str:
    dedup = ("transform(filter(transform(cr, (q, j) -> named_struct('p', q, 'k', "
             "j = 0 OR q != element_at(cr, j))), z -> z.k), z -> z.p)")
    return (f"transform({rings}, cr -> CASE WHEN size({dedup}) > 1 AND "
                f"element_at({dedup}, 1) = element_at({dedup}, -1) "
                f"THEN slice({dedup}, 1, size({dedup}) - 1) ELSE {dedup} END)")


def clean_rings(rings: str) -> Column:
    return col(clean_rings_sql(rings))


def rings_valid(rings: str) -> Column:
    """Every ring has at least three distinct vertices."""
    return col(f"forall({rings}, vr -> size(array_distinct(vr)) >= 3)")
