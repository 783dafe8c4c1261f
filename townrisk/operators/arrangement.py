"""Planar arrangements of polygon edges as Spark jobs: adaptive cells, noding, windings, rings.

Edges are rows ``_k, x1, y1, x2, y2`` (doubles), directed with the polygon on
their left; ``ma`` and ``mb`` are how often an edge counts, for two layers.

*Cells.* :func:`cover` deals the edges of every key to grid cells and splits a
cell into four as long as it holds more than ``limit`` edges, one level a job
and one row an edge. Every cell knows the windings at its lower left corner.
For cells of the base grid they are running sums along the row, for a split
cell's children the sums over the parent's edges that cross the way from the
parent's corner. So the winding of any point takes the edges of its own cell
only: those that cross the way from the corner, up its left side and then to
the right.

*Noding.* :func:`noded` cuts edges of one key where they cross or touch.
Coordinates are whole numbers of a grid; a crossing is rounded to the grid, and
an end nearer than ``NEAR`` units to an edge cuts it, so that borders that
nearly coincide do coincide afterwards. Cut edges can cross others by a unit,
so it is repeated until nothing is cut. Only edges of one cell are compared.

*Rings.* :func:`boundary` keeps the noded edges with the region on one side
only, directed with it on the left; :func:`rings` links each to the next around
its end and finds rings and places in them by pointer doubling.

An end shared by more than ``limit`` edges can't be split apart; its cell stays
as it is after ``depth`` levels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from .sizing import cut_lineage
from .strips import windings

LIMIT = 48
CROWD = 1 << 15
POINTS = 1 << 16
DEPTH = 24
NEAR = 0.75
ROUNDS = 16
CELL = ["_k", "_l", "_i", "_j"]
ENDS = ["x1", "y1", "x2", "y2"]
_EDGE = "struct<x1:double,y1:double,x2:double,y2:double,ma:bigint,mb:bigint>"


def polygon_edges(df: DataFrame, key: str, rings: str, grid: float | None = None, a: int = 1, b: int = 0) -> DataFrame:
    """Directed edges of the polygons, in units of ``grid`` (rounded) if it is given; edges without length go."""
    e = df.select(F.col(key).alias("_k"), F.explode(G.poly_edges(rings)).alias("e"))

    def at(c: str) -> Column:
        return F.rint(F.col(f"e.{c}") / F.lit(float(grid))) if grid else F.col(f"e.{c}")

    e = e.select("_k", *[at(c).alias(c) for c in ENDS], F.lit(a).cast("long").alias("ma"), F.lit(b).cast("long").alias("mb"))
    return e.where("x1 <> x2 or y1 <> y2")


# --- cells --------------------------------------------------------------------

def _touches(lo_x: str, hi_x: str, lo_y: str, hi_y: str) -> str:
    """SQL: the edge meets the box (boxes are widened by the caller, so rounding can't lose one)."""
    ya, yb = f"greatest(least(y1, y2), {lo_y})", f"least(greatest(y1, y2), {hi_y})"

    def x(y: str) -> str:
        return f"if(y1 = y2, {{0}}(x1, x2), (x2 - x1) * ({y} - y1) / (y2 - y1) + x1)"

    lo = f"least({x(ya).format('least')}, {x(yb).format('least')})"
    hi = f"greatest({x(ya).format('greatest')}, {x(yb).format('greatest')})"
    return f"least(y1, y2) <= {hi_y} and greatest(y1, y2) >= {lo_y} and {hi} >= {lo_x} and {lo} <= {hi_x}"


def _left(e: str, x: str, y: str) -> str:
    """SQL: the point is left of the edge; one on it counts as a trifle to the east of it (above a level one).

    Every decision on a corner takes this one predicate, so they can't contradict each other.
    """
    turn = f"({e}x2 - {e}x1) * ({y} - {e}y1) - ({e}y2 - {e}y1) * ({x} - {e}x1)"
    return f"(case when {turn} <> 0 then {turn} > 0 when {e}y2 <> {e}y1 then {e}y2 < {e}y1 else {e}x2 > {e}x1 end)"


def _up(e: str, x0: str, y0: str, y: str) -> str:
    """SQL: 1 for an edge crossed from right to left on the way up from (x0, y0) to (x0, y), -1 from left to right, else 0."""
    at, end = _left(e, x0, y0), _left(e, x0, y)
    return (f"case when ({e}x1 > {x0}) = ({e}x2 > {x0}) then 0 when {e}x2 > {e}x1 then if({end} and not {at}, 1, 0) "
            f"else if({at} and not {end}, -1, 0) end")


def way_sql(e: str, x0: str, y0: str, x: str, y: str, corner: bool = True) -> str:
    """SQL: the same on the way (x0, y0) - (x0, y) - (x, y), up and to the right, to a corner or to any point."""
    at, end = _left(e, x0, y), _left(e, x, y)
    west = f"({x} < ({e}x2 - {e}x1) * ({y} - {e}y1) / ({e}y2 - {e}y1) + {e}x1)"
    up, down = (end, end) if corner else (west, f"(not {west})")
    return (f"({_up(e, x0, y0, y)} + case when ({e}y1 > {y}) = ({e}y2 > {y}) then 0 "
            f"when {e}y2 > {e}y1 then if({at} and not {up}, -1, 0) else if({down} and not {at}, 1, 0) end)")


def _base(edges: DataFrame, cell: float) -> DataFrame:
    c, m = repr(float(cell)), repr(cell * 1e-9)
    e = edges.withColumn("_j", F.explode(F.expr(
        f"sequence(cast(floor((least(y1, y2) - {m}) / {c}) as bigint), cast(floor((greatest(y1, y2) + {m}) / {c}) as bigint))")))
    ya, yb = f"greatest(least(y1, y2), _j * {c})", f"least(greatest(y1, y2), (_j + 1) * {c})"
    x = "if(y1 = y2, {1}(x1, x2), least(greatest((x2 - x1) * ({0} - y1) / (y2 - y1) + x1, least(x1, x2)), greatest(x1, x2)))"
    lo = f"least({x.format(ya, 'least')}, {x.format(yb, 'least')})"
    hi = f"greatest({x.format(ya, 'greatest')}, {x.format(yb, 'greatest')})"
    return e.withColumn("_i", F.explode(F.expr(
        f"sequence(cast(floor(({lo} - {m}) / {c}) as bigint), cast(floor(({hi} + {m}) / {c}) as bigint))"))).withColumn("_l", F.lit(0))


def _base_corners(rows: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """(corners of the cells with edges, cells without edges inside a polygon), by running sums along the rows."""
    c = repr(float(cell))
    cross = way_sql("", f"(_i * {c})", f"(_j * {c})", f"((_i + 1) * {c})", f"(_j * {c})")
    sums = rows.groupBy("_k", "_j", "_i").agg(F.sum(F.expr(f"{cross} * ma")).alias("da"), F.sum(F.expr(f"{cross} * mb")).alias("db"))
    row = Window.partitionBy("_k", "_j").orderBy("_i")
    run = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = sums.select("_k", "_j", "_i", F.lag("_i", 1).over(row).alias("_prev"),
                     *[(F.sum(f"d{x}").over(run) - F.col(f"d{x}")).alias(f"w{x}") for x in "ab"])
    # between two cells with edges the winding is that of the later one's corner
    gaps = at.where("_prev is not null and _i > _prev + 1 and (wa <> 0 or wb <> 0)").select(
        "_k", F.lit(0).alias("_l"), F.explode(F.expr("sequence(_prev + 1, _i - 1)")).alias("_i"), "_j", "wa", "wb")
    return at.select("_k", F.lit(0).alias("_l"), "_i", "_j", "wa", "wb"), gaps


def _children(big: DataFrame, cell: float, level: int, corners: bool) -> tuple[DataFrame, DataFrame | None]:
    """(edges of the four children, their corners) of cells given as edges with their corner."""
    size = cell / 2 ** level
    half, m = repr(size / 2), repr(size * 1e-9)
    four = F.explode(F.expr("array(struct(0L as u, 0L as v), struct(1L as u, 0L as v), struct(0L as u, 1L as v), struct(1L as u, 1L as v))"))
    e = big.withColumn("_c", four).withColumns({"_ci": F.expr("2 * _i + _c.u"), "_cj": F.expr("2 * _j + _c.v")})
    way = way_sql("", f"(2 * _i * {half})", f"(2 * _j * {half})", f"(_ci * {half})", f"(_cj * {half})")
    box = _touches(f"(_ci * {half} - {m})", f"((_ci + 1) * {half} + {m})", f"(_cj * {half} - {m})", f"((_cj + 1) * {half} + {m})")
    rows = e.where(box).select("_k", F.lit(level + 1).alias("_l"), F.col("_ci").alias("_i"), F.col("_cj").alias("_j"), *ENDS, "ma", "mb")
    if not corners:
        return rows, None
    at = e.groupBy("_k", "_ci", "_cj").agg(*[(F.first(f"w{x}") + F.sum(F.expr(f"{way} * m{x}"))).alias(f"w{x}") for x in "ab"])
    return rows, at.select("_k", F.lit(level + 1).alias("_l"), F.col("_ci").alias("_i"), F.col("_cj").alias("_j"), "wa", "wb")


def cover(edges: DataFrame, cell: float, limit: int = LIMIT, depth: int = DEPTH, inside: bool = False,
          corners: bool = True, gather: bool = True) -> tuple[DataFrame, int]:
    """(_k, _l, _i, _j, wa, wb, edges of every cell; the deepest level).

    ``_l`` is the level: cells are ``cell / 2^_l`` wide and start at (_i, _j)
    times that. ``edges`` has at most ``limit`` edges (see the module's note on
    shared ends), all that meet the closed cell. With ``inside``, cells without
    edges but with a winding are listed too; without ``corners`` no windings are.
    Without ``gather`` an edge is a row, with x1, y1, x2, y2, ma, mb (null in
    cells without edges) for ``edges``, for limits too large for an array.
    """
    held = F.collect_list(F.struct(*ENDS, "ma", "mb")).cast(f"array<{_EDGE}>").alias("edges")
    w = ["wa", "wb"] if corners else []
    none = [F.array().cast(f"array<{_EDGE}>").alias("edges")] if gather else \
        [F.lit(None).cast("double").alias(c) for c in ENDS] + [F.lit(None).cast("long").alias(c) for c in ("ma", "mb")]
    kept = ["edges"] if gather else [*ENDS, "ma", "mb"]
    rows = cut_lineage(_base(edges, cell).select(*CELL, *ENDS, "ma", "mb"), "cell-edges")
    at, empty = _base_corners(rows, cell) if corners else (None, None)
    done, level = [empty.select(*CELL, *w, *none)] if inside else [], 0
    while True:
        sizes = rows.groupBy(*CELL).agg(F.count("*").alias("_n"))
        last = level >= depth or (sizes.agg(F.max("_n")).first()[0] or 0) <= limit
        crowded = None if last else cut_lineage(sizes.where(F.col("_n") > limit).drop("_n"), "crowded-cells")
        leaves = rows if last else rows.join(crowded, CELL, "left_anti")
        leaves = leaves.groupBy(*CELL).agg(held) if gather else leaves
        done.append((leaves.join(at, CELL) if corners else leaves).select(*CELL, *w, *kept))
        if last:
            break
        big = rows.join(crowded, CELL, "left_semi")
        rows, below = _children(big.join(at, CELL) if corners else big, cell, level, corners)
        rows = cut_lineage(rows, "cell-edges")
        if corners:
            at = cut_lineage(below, "cell-corners")
        if inside:
            done.append(at.where("wa <> 0 or wb <> 0").join(rows.select(*CELL).distinct(), CELL, "left_anti").select(*CELL, *w, *none))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, level


def cell_size(edges: DataFrame, per_side: int = 16) -> float:
    """A base cell for ``edges``: a power of two, about 1 / ``per_side`` of the widest key, so that cells hold their share."""
    box = edges.groupBy("_k").agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x1"),
                                  F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y1"))
    widest = box.agg(F.max(F.expr("greatest(x1 - x0, y1 - y0)"))).first()[0] or 1.0
    size = 1.0
    while size * per_side < widest:
        size *= 2
    while size * per_side / 2 >= widest:
        size /= 2
    return size


def _corner_sql(cell: float) -> tuple[str, str]:
    size = f"({float(cell)!r} / shiftleft(1L, _l))"
    return f"(_i * {size})", f"(_j * {size})"


def winding_sql(layer: str, cell: float, x: str, y: str) -> str:
    """SQL over a cover's row: the winding at (x, y), a point of the cell."""
    return f"aggregate(edges, w{layer}, (w, b) -> w + {way_sql('b.', *_corner_sql(cell), x, y, corner=False)} * b.m{layer})"


# --- noding -------------------------------------------------------------------

def merged(edges: DataFrame) -> DataFrame:
    """One row an undirected edge, from its smaller end, with what its directed copies sum up to; ``n`` copies."""
    back = "x1 > x2 or (x1 = x2 and y1 > y2)"
    sign = F.expr(f"if({back}, -1, 1)")
    e = edges.select("_k", *[F.expr(f"if({back}, {o}, {c})").alias(f"_{c}") for c, o in zip(ENDS, ("x2", "y2", "x1", "y1"), strict=True)],
                     (F.col("ma") * sign).alias("ma"), (F.col("mb") * sign).alias("mb"), *(["n"] if "n" in edges.columns else [F.lit(1).cast("long").alias("n")]))
    e = e.where("_x1 <> _x2 or _y1 <> _y2").groupBy("_k", *[f"_{c}" for c in ENDS]).agg(F.sum("ma").alias("ma"), F.sum("mb").alias("mb"), F.sum("n").alias("n"))
    return e.select("_k", *[F.col(f"_{c}").alias(c) for c in ENDS], "ma", "mb", "n")


def _cuts(cells: DataFrame) -> DataFrame:
    """(edge, px, py): where edges of a cell must be cut."""
    a = cells.select("_k", "edges", F.explode("edges").alias("a")).select("_k", "a", F.explode("edges").alias("b"))
    a = a.where("a <> b and least(a.x1, a.x2) <= greatest(b.x1, b.x2) + 1 and least(b.x1, b.x2) <= greatest(a.x1, a.x2) + 1"
                " and least(a.y1, a.y2) <= greatest(b.y1, b.y2) + 1 and least(b.y1, b.y2) <= greatest(a.y1, a.y2) + 1")
    dx, dy = "(a.x2 - a.x1)", "(a.y2 - a.y1)"
    a = a.withColumn("_len2", F.expr(f"{dx} * {dx} + {dy} * {dy}"))

    def off(e: str, p: str) -> str:  # twice the area of e and a point
        return f"(({e}.x2 - {e}.x1) * ({p[0]} - {e}.y1) - ({e}.y2 - {e}.y1) * ({p[1]} - {e}.x1))"

    a = a.withColumns({"_o1": F.expr(off("a", ("b.y1", "b.x1"))), "_o2": F.expr(off("a", ("b.y2", "b.x2"))),
                       "_o3": F.expr(off("b", ("a.y1", "a.x1"))), "_o4": F.expr(off("b", ("a.y2", "a.x2")))})

    def end(k: int) -> str:
        along = f"({dx} * (b.x{k} - a.x1) + {dy} * (b.y{k} - a.y1))"
        return (f"if(_o{k} * _o{k} < {NEAR * NEAR} * _len2 and {along} > 0 and {along} < _len2, "
                f"struct(b.x{k} as px, b.y{k} as py), null)")

    t = "_o3 / (_o3 - _o4)"
    cross = (f"if(((_o1 > 0 and _o2 < 0) or (_o1 < 0 and _o2 > 0)) and ((_o3 > 0 and _o4 < 0) or (_o3 < 0 and _o4 > 0)), "
             f"struct(rint(a.x1 + {t} * {dx}) as px, rint(a.y1 + {t} * {dy}) as py), null)")
    # a crossing next to an end of either edge is that end
    p = a.select("_k", "a", "b", F.expr(end(1)).alias("e1"), F.expr(end(2)).alias("e2"), F.expr(cross).alias("c"))
    p = p.select("_k", "a", F.explode(F.expr("filter(array(e1, e2, c), p -> p is not null)")).alias("p"))
    p = p.select("_k", *[F.col(f"a.{c}").alias(c) for c in ENDS], "p.px", "p.py")
    return p.where("not (px = x1 and py = y1) and not (px = x2 and py = y2)").distinct()


def _cut(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """``edges`` cut at their points, as directed pieces."""
    key = ["_k", *ENDS]
    both = edges.join(cuts.select(*key).distinct(), key, "left_semi")
    dx, dy = "(x2 - x1)", "(y2 - y1)"
    points = cuts.unionByName(both.select(*key, F.col("x2").alias("px"), F.col("y2").alias("py"))).withColumn(
        "_t", F.expr(f"if(px = x2 and py = y2, double('Infinity'), {dx} * (px - x1) + {dy} * (py - y1))"))
    along = Window.partitionBy(*key).orderBy("_t", "px", "py")
    pieces = points.withColumns({"_sx": F.coalesce(F.lag("px", 1).over(along), F.col("x1")), "_sy": F.coalesce(F.lag("py", 1).over(along), F.col("y1"))})
    pieces = pieces.join(both, key).select("_k", F.col("_sx").alias("x1"), F.col("_sy").alias("y1"), F.col("px").alias("x2"), F.col("py").alias("y2"),
                                           "ma", "mb", "n")
    return edges.join(cuts.select(*key).distinct(), key, "left_anti").select("_k", *ENDS, "ma", "mb", "n").unionByName(pieces)


def noded(edges: DataFrame, cell: float | None = None, limit: int = LIMIT) -> DataFrame:
    """``edges`` (whole coordinates) cut until they meet in ends only, merged: _k, x1, y1, x2, y2, ma, mb, n."""
    e = cut_lineage(merged(edges), "edges")
    cell = cell or cell_size(e)
    for _ in range(ROUNDS):
        cells, _ = cover(e, cell, limit, _levels(cell), corners=False)
        cuts = cut_lineage(_cuts(cells), "cuts")
        if cuts.isEmpty():
            return e
        e = cut_lineage(merged(_cut(e, cuts)), "edges")
    raise ValueError(f"edges still cross after {ROUNDS} rounds of cutting")


def _levels(cell: float) -> int:
    """Cells of whole coordinates aren't split below a unit."""
    return min(DEPTH, max(0, math.frexp(cell)[1] - 1))


def sides(edges: DataFrame, cell: float | None = None, limit: int = LIMIT) -> DataFrame:
    """Noded ``edges`` with the windings of both layers on their left (la, lb) and right (ra, rb) side."""
    cell = cell or cell_size(edges)
    # a quarter of a unit aside neither an end nor the middle of an edge is on a cell's border
    moved = edges.select("_k", *[(F.col(c) + 0.25).alias(c) for c in ENDS], "ma", "mb")
    cells, _ = cover(moved, cell, limit, _levels(cell))
    x0, y0 = _corner_sql(cell)
    size = f"({float(cell)!r} / shiftleft(1L, _l))"
    e = cells.select("*", F.explode("edges").alias("a")).withColumns({"_mx": F.expr("(a.x1 + a.x2) / 2"), "_my": F.expr("(a.y1 + a.y2) / 2")})
    e = e.where(f"floor(_mx / {size}) = _i and floor(_my / {size}) = _j")  # the cell of the edge's middle
    # the way to the middle comes from the west; it passes above a level edge. Of the edge itself only the part up to there counts
    own = f"if(a.x1 <= {x0} and a.x2 > {x0} and a.y2 >= a.y1 and not {_left('a.', x0, y0)}, 1, 0)"
    way = way_sql("b.", x0, y0, "_mx", "_my", corner=False)
    steps = f"transform(edges, b -> struct(if(b <=> a, {own}, {way}) as d, b.ma as ma, b.mb as mb))"
    e = e.select("_k", "a", F.expr(f"aggregate({steps}, struct(wa, wb), (w, s) -> struct(w.wa + s.d * s.ma as wa, w.wb + s.d * s.mb as wb))").alias("_w"))
    # a table of its own: the windings are used several times
    e = cut_lineage(e.select("_k", *[(F.col(f"a.{c}") - 0.25).alias(c) for c in ENDS], "a.ma", "a.mb", "_w.wa", "_w.wb"), "windings")
    # west of an edge that runs down is its right side
    return e.select("_k", *ENDS, *[F.expr(f"if(y2 < y1, w{x} + m{x}, w{x})").alias(f"l{x}") for x in "ab"],
                    *[F.expr(f"if(y2 < y1, w{x}, w{x} - m{x})").alias(f"r{x}") for x in "ab"])


def boundary(edges: DataFrame, inside: Callable[[str, str], str], cell: float | None = None, limit: int = LIMIT) -> DataFrame:
    """Edges with the region on one side only, directed with it on their left; ``inside`` is SQL over both windings."""
    s = sides(edges, cell, limit).withColumns({"_in_l": F.expr(inside("la", "lb")), "_in_r": F.expr(inside("ra", "rb"))})
    return s.where("_in_l <> _in_r").select("_k", *[F.expr(f"if(_in_l, {c}, {o})").alias(c) for c, o in zip(ENDS, ("x2", "y2", "x1", "y1"), strict=True)])


def area_of(bound: DataFrame, key: str, grid: float = 1.0) -> DataFrame:
    """(key, area) of regions given by directed boundary edges."""
    low = bound.groupBy("_k").agg(F.min("y1").alias("_y0"))
    e = bound.join(low, "_k").select("_k", F.expr("(x1 - x2) * ((y1 - _y0) + (y2 - _y0)) / 2").alias("_a"))
    return e.groupBy("_k").agg((F.sum("_a") * F.lit(float(grid) * float(grid))).alias("area")).withColumnRenamed("_k", key)


# --- rings --------------------------------------------------------------------

def _onward(clockwise: bool) -> Column:
    """The angle from the way back (x1, y1) to the way on (_tx, _ty) around (x2, y2), in (0, 2 pi]."""
    back, on = ("(x1 - x2)", "(y1 - y2)"), ("(_tx - x2)", "(_ty - y2)")
    angle = f"atan2({back[0]} * {on[1]} - {back[1]} * {on[0]}, {back[0]} * {on[0]} + {back[1]} * {on[1]})"
    angle = f"-({angle})" if clockwise else angle
    return F.expr(f"if({angle} > 0, {angle}, {angle} + 2 * pi())")


def _linked(edges: DataFrame, clockwise: bool, among: list[str]) -> DataFrame:
    """(_e, _next): the edge that goes on from an edge's end, of those equal in ``among`` the first around the end."""
    on = edges.select(*among, F.col("_e").alias("_next"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("_tx"), F.col("y2").alias("_ty"))
    j = edges.join(on, [*among, "x2", "y2"])
    return j.groupBy("_e").agg(F.min_by("_next", F.struct(_onward(clockwise), "_next")).alias("_next"))


def _cycles(links: DataFrame) -> DataFrame:
    """(_e, _ring, _ahead): the smallest edge of each edge's cycle and the steps to it, by pointer doubling, two to a table."""
    def doubled(at: DataFrame, reach: int) -> DataFrame:
        far = at.select(F.col("_e").alias("_to"), F.col("_to").alias("_far"), F.col("_ring").alias("_other"), F.col("_ahead").alias("_more"))
        lower = F.col("_other") < F.col("_ring")
        return at.join(far, "_to").select("_e", F.col("_far").alias("_to"), F.least("_ring", "_other").alias("_ring"),
                                          F.when(lower, F.col("_more") + reach).otherwise(F.col("_ahead")).alias("_ahead"), lower.alias("_lower"))

    # _ring is the smallest of the next ``reach`` edges, _to the edge after them
    at, reach = links.select("_e", F.col("_next").alias("_to"), F.col("_e").alias("_ring"), F.lit(0).cast("long").alias("_ahead")), 1
    while True:
        at, reach = cut_lineage(doubled(doubled(at, reach), 2 * reach), "links"), 4 * reach
        if at.where("_lower").isEmpty():  # so before that step the reach was whole cycles
            return at.select("_e", "_ring", "_ahead")


def rings(bound: DataFrame) -> DataFrame:
    """(_k, _ring, _at, x, y): the vertices of the rings that directed boundary edges form.

    Around an end the way first goes on along the inside, so that every ring
    bounds a connected part; one that comes back to an end is then parted there
    along the outside, so that a hole that touches its shell is a ring of its
    own and every ring is simple.
    """
    e = cut_lineage(bound.select("_k", *ENDS, F.monotonically_increasing_id().alias("_e")), "boundary")
    links = cut_lineage(_linked(e, True, ["_k"]), "links")
    cycles = _cycles(links)
    of_ring = e.join(cycles, "_e")
    again = of_ring.groupBy("_k", "_ring", "x2", "y2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = cut_lineage(again, "touching")
    if not again.isEmpty():
        # all edges that start or end there, of the same ring
        ends = of_ring.join(again, ["_k", "_ring", "x2", "y2"], "left_semi")
        starts = of_ring.join(again.withColumnsRenamed({"x2": "x1", "y2": "y1"}), ["_k", "_ring", "x1", "y1"], "left_semi")
        parted = _linked(ends.unionByName(starts).distinct(), False, ["_k", "_ring"]).join(ends.select("_e"), "_e", "left_semi")
        links = cut_lineage(links.join(parted.withColumnRenamed("_next", "_part"), "_e", "left")
                            .select("_e", F.coalesce("_part", "_next").alias("_next")), "links")
        cycles = _cycles(links)
    v = cycles.join(e, "_e")
    # places count from the smallest vertex
    start = v.groupBy("_ring").agg(F.min_by("_ahead", F.struct("x1", "y1")).alias("_s"), F.count("*").alias("_n"))
    return v.join(start, "_ring").select("_k", "_ring", F.expr("(_s - _ahead + _n) % _n").alias("_at"), F.col("x1").alias("x"), F.col("y1").alias("y"))


def ring_measures(vertices: DataFrame) -> DataFrame:
    """(_k, _ring, n, area): vertices and signed area of every ring; holes are negative. No ring is held whole."""
    nxt = vertices.select("_k", "_ring", F.col("_at").alias("_p"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    size = vertices.groupBy("_k", "_ring").agg(F.count("*").alias("n"), F.min("y").alias("_y0"))
    e = vertices.join(size, ["_k", "_ring"]).withColumn("_p", F.expr("(_at + 1) % n")).join(nxt, ["_k", "_ring", "_p"])
    return e.groupBy("_k", "_ring").agg(F.first("n").alias("n"), F.sum(F.expr("(x - x2) * ((y - _y0) + (y2 - _y0)) / 2")).alias("area"))


def nested(vertices: DataFrame, measures: DataFrame, cell: float | None = None) -> DataFrame:
    """``measures`` with _shell: the ring itself, or for a hole the smallest shell around it."""
    shells = measures.withColumn("_shell", F.col("_ring"))
    holes = measures.where("area < 0")
    if holes.isEmpty():
        return shells
    nxt = vertices.where("_at = 1").select("_ring", F.col("x").alias("_x2"), F.col("y").alias("_y2"))
    # the middle of an edge lies on no other ring
    middles = holes.join(vertices.where("_at = 0").select("_ring", "x", "y"), "_ring").join(nxt, "_ring") \
        .select(F.col("_k").alias("_hk"), F.col("_ring").alias("_hole"), ((F.col("x") + F.col("_x2")) / 2).alias("_px"), ((F.col("y") + F.col("_y2")) / 2).alias("_py"))
    around = measures.where("area > 0").select(F.col("_k").alias("_sk"), "_ring", F.col("area").alias("_around"))
    own = vertices.join(around.select("_ring"), "_ring", "left_semi")
    e = own.select("_ring", "_at", F.col("x").alias("x1"), F.col("y").alias("y1")).join(
        own.join(measures.select("_ring", "n"), "_ring").select("_ring", F.expr("(_at + n - 1) % n").alias("_at"), F.col("x").alias("x2"), F.col("y").alias("y2")), ["_ring", "_at"])
    e = cut_lineage(e.select(F.col("_ring").alias("_k"), *ENDS, F.lit(1).cast("long").alias("ma"), F.lit(0).cast("long").alias("mb")), "shells")
    cell = cell or cell_size(e)
    hits = points_in(middles, cover(e, cell, inside=True), cell, "_px", "_py", "_in").join(around.withColumnRenamed("_ring", "_in"), "_in").where("_hk = _sk")
    best = hits.groupBy("_hole").agg(F.min_by("_in", F.struct("_around", "_in")).alias("_best"))
    return shells.join(best.withColumnRenamed("_hole", "_ring"), "_ring", "left").withColumn("_shell", F.coalesce("_best", "_shell")).drop("_best")


def points_in(points: DataFrame, covered: tuple[DataFrame, int], cell: float, x: str, y: str, key: str) -> DataFrame:
    """``points`` with ``key``, a row for each polygon of a cover (with ``inside``) that holds the point by the even-odd rule."""
    cells, deepest = covered
    cells = cells.where("size(edges) > 0 or wa % 2 <> 0")
    p = points.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(deepest))) if deepest else F.lit(0))
    size = f"({float(cell)!r} / shiftleft(1L, _l))"
    p = p.withColumns({"_i": F.expr(f"cast(floor(`{x}` / {size}) as bigint)"), "_j": F.expr(f"cast(floor(`{y}` / {size}) as bigint)")})
    j = p.join(cells, ["_l", "_i", "_j"]).where(winding_sql("a", cell, f"`{x}`", f"`{y}`") + " % 2 <> 0")
    return j.withColumn(key, F.col("_k")).select(*points.columns, key)


def _cell_windings(cell: float, x: str, y: str, key: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Points of a cell and its edges to those points with an odd winding."""
    def run(points: pa.Table, edges: pa.Table) -> pa.Table:
        names = [c for c in points.column_names if c not in ("_k", "_l", "_i", "_j", "_part")]
        if not points.num_rows or not edges.num_rows:
            return points.slice(0, 0).select([*names, "_k"]).rename_columns([*names, key])
        size = cell / 2 ** points["_l"][0].as_py()
        ends = tuple(edges[c].to_numpy() for c in ENDS)
        w = windings(ends, edges["ma"].to_numpy(), edges["wa"][0].as_py(), points["_i"][0].as_py() * size, points["_j"][0].as_py() * size, size,
                     points[x].to_numpy(), points[y].to_numpy())
        return points.filter(pa.array(w % 2 != 0)).select([*names, "_k"]).rename_columns([*names, key])
    return run


def points_in_crowded(points: DataFrame, covered: tuple[DataFrame, int], cell: float, x: str, y: str, key: str, most: int = POINTS) -> DataFrame:
    """:func:`points_in` for a cover that isn't gathered, whose cells may hold many thousand edges.

    Where many long edges lie side by side, splitting cells down to a few
    edges takes rows by the square of the edges. Here points find their cell
    in the list of cells, and a task tests up to ``most`` points of a cell with
    its edges, sorted (:mod:`strips`).
    """
    rows, deepest = covered
    cells = cut_lineage(rows.groupBy(*CELL).agg(F.first("wa").alias("wa"), F.count("x1").alias("_n")), "cells")
    p = points.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(deepest))) if deepest else F.lit(0))
    size = f"({float(cell)!r} / shiftleft(1L, _l))"
    p = p.withColumns({"_i": F.expr(f"cast(floor(`{x}` / {size}) as bigint)"), "_j": F.expr(f"cast(floor(`{y}` / {size}) as bigint)")})
    whole = p.join(cells.where("_n = 0 and wa % 2 <> 0"), ["_l", "_i", "_j"]).withColumn(key, F.col("_k")).select(*points.columns, key)
    cells = cells.where("_n > 0").select(*CELL)
    parts = p.join(cells, ["_l", "_i", "_j"]).groupBy(*CELL).agg(F.ceil(F.count("*") / F.lit(float(most))).cast("int").alias("_parts"))
    parts = cut_lineage(parts, "cell-parts")
    part = F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int").alias("_part")
    dealt = p.join(parts, ["_l", "_i", "_j"]).select(*points.columns, *CELL, part)
    edges = rows.join(parts, CELL).select(*CELL, "wa", *ENDS, "ma", F.explode(F.expr("sequence(0, _parts - 1)")).alias("_part"))
    by = [*CELL, "_part"]
    schema = points.select(*points.columns).schema.add(key, rows.schema["_k"].dataType)
    tested = dealt.groupBy(*by).cogroup(edges.groupBy(*by)).applyInArrow(_cell_windings(cell, x, y, key), schema)
    return whole.unionByName(tested)


def ring_rows(vertices: DataFrame, measures: DataFrame, grid: float = 1.0) -> DataFrame:
    """(_k, _ring, _shell, area, ring): a row a ring with its vertices in order, in the original unit (``grid`` is its share)."""
    per = round(1 / grid) if grid < 1 else None  # a whole number divides exactly where the grid's own value doesn't

    def back(c: str) -> Column:
        return (F.col(c) / F.lit(float(per)) if per and abs(per * grid - 1) < 1e-12 else F.col(c) * F.lit(float(grid))).alias(c)

    points = vertices.select("_ring", "_at", back("x"), back("y")).groupBy("_ring").agg(
        F.expr("transform(array_sort(collect_list(struct(_at, x, y))), p -> struct(p.x as x, p.y as y))").alias("ring"))
    return measures.withColumn("area", F.col("area") * F.lit(float(grid) ** 2)).join(points, "_ring").select("_k", "_ring", "_shell", "area", "ring")


def repaired(df: DataFrame, key: str, rings_col: str, grid: float = 1e-8, limit: int = LIMIT) -> DataFrame:
    """(key, _ring, _shell, area, ring): valid rings of the polygons, by the even-odd rule.

    A point belongs to the repaired polygon if it is inside an odd number of
    loops. Rings that cross themselves are cut at the crossings; coinciding
    edges go in pairs; shells run counter-clockwise and holes clockwise. A
    polygon that has no area left has no row.
    """
    e = noded(polygon_edges(df, key, rings_col, grid), limit=limit)
    odd = cut_lineage(e.where("n % 2 = 1").withColumn("ma", F.lit(1).cast("long")), "odd-edges")
    v = cut_lineage(rings(boundary(odd, lambda a, _: f"{a} % 2 <> 0", limit=limit)), "rings")
    m = cut_lineage(ring_measures(v), "ring-measures")
    return ring_rows(v, nested(v, m), grid).withColumnRenamed("_k", key)


def flawed(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Keys (_k) whose edges meet anywhere but in their ends, or lie on one another."""
    e = cut_lineage(merged(edges), "edges")
    cell = cell_size(e)
    cells, _ = cover(e, cell, limit, _levels(cell), corners=False)
    return _cuts(cells).select("_k").unionByName(e.where("n > 1").select("_k")).distinct()
