"""Windings of many points in one crowded cell, by level strips (numpy, inside a task).

A cell is cut into strips. In a strip most edges run from its lower to its
upper border, clear of the cell's left side; sorted by their place they are
summed up for the points east of them, and only those beside a point are
tested. All other edges of the strip are tested for each of its points, with the
predicates of :mod:`arrangement`. Nothing is assumed about edges that cross.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 15


def _left(e: tuple, x, y):
    x1, y1, x2, y2 = e
    turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return np.where(turn != 0, turn > 0, np.where(y2 != y1, y2 < y1, x2 > x1))


def _up(e: tuple, x0: float, y0: float, y):
    x1, _, x2, _ = e
    at, end = _left(e, x0, y0), _left(e, x0, y)
    return np.where((x1 > x0) == (x2 > x0), 0, np.where(x2 > x1, (end & ~at) * 1, (at & ~end) * -1))


def _right(e: tuple, x0: float, x, y):
    x1, y1, x2, y2 = e
    level = (y1 > y) == (y2 > y)
    at = _left(e, x0, y)
    east = x >= (x2 - x1) * (y - y1) / np.where(level, 1.0, y2 - y1) + x1
    return np.where(level | ~east, 0, np.where(y2 > y1, at * -1, ~at * 1))


def _each(of: int, with_: int):
    """Slices of ``of`` rows that make a block with ``with_`` columns each."""
    step = max(1, BLOCK // max(1, with_))
    return (slice(a, a + step) for a in range(0, of, step))


def _east_of(e: tuple, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What edges that lie east of the left side count for points: all that cross a point's level west of it."""
    x1, y1, x2, y2 = e
    out, dx, dy, turn = np.zeros(len(x)), x2 - x1, y2 - y1, np.where(y2 > y1, -m, m).astype(float)
    dy = np.where(dy == 0, 1.0, dy)
    for r in _each(len(x), len(m)):
        px, py = x[r, None], y[r, None]
        cross = ((y1 > py) != (y2 > py)) & (px >= dx * (py - y1) / dy + x1)
        out[r] = cross @ turn
    return out


def _beside(e: tuple, m: np.ndarray, x0: float, y0: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What edges that may cross the left side count, by the full predicates."""
    out = np.zeros(len(x))
    for r in _each(len(x), len(m)):
        px, py = x[r, None], y[r, None]
        out[r] = (_up(e, x0, y0, py) + _right(e, x0, px, py)) @ m
    return out


def _sorted_east_of(e: tuple, m: np.ndarray, west: np.ndarray, wide: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same as :func:`_east_of` for edges through the whole strip, at most ``wide``: only those beside a point are tested."""
    k = np.argsort(west, kind="stable")
    x1, y1, x2, y2 = (c[k] for c in e)
    west, dx, dy, turn = west[k], x2 - x1, y2 - y1, np.where(y2 > y1, -m[k], m[k]).astype(float)
    i, j = np.searchsorted(west, x - wide), np.searchsorted(west, x, side="right")
    i = np.minimum(i, j)
    # edges before i lie west of the point, those from j on east of it
    out = np.concatenate([[0.0], np.cumsum(turn)])[i]
    most = j - i
    ends, a = np.cumsum(most), 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, side="right")))
        n = most[a:b]
        of = np.repeat(np.arange(a, b), n)
        c = np.arange(len(of)) + np.repeat(i[a:b] - (np.cumsum(n) - n), n)
        cross = x[of] >= dx[c] * (y[of] - y1[c]) / dy[c] + x1[c]
        out[a:b] += np.bincount(of - a, weights=cross * turn[c], minlength=b - a)
        a = b
    return out


def windings(edges: tuple, m: np.ndarray, corner: int, x0: float, y0: float, size: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The winding at each point of the cell; ``edges`` is (x1, y1, x2, y2), all that meet it, ``corner`` the winding at (x0, y0)."""
    n = max(1, min(int(np.ceil(0.8 * np.sqrt(len(x)))), len(m) // 8))
    at = np.clip(np.floor((y - y0) / size * n).astype(np.int64), 0, n - 1)
    order = np.lexsort((x, at))
    first = np.searchsorted(at[order], np.arange(n + 1))
    lo, hi = np.minimum(edges[1], edges[3]), np.maximum(edges[1], edges[3])
    left = (edges[0] > x0) != (edges[2] > x0)
    left = tuple(c[left] for c in edges), m[left]
    # wider than what rounding can move a crossing by
    margin = size * 1e-9 + 1e-12 * max([abs(x0) + size, *(np.abs(c).max() for c in edges if len(c))])
    out = np.empty(len(x), dtype=np.int64)
    for s in np.flatnonzero(np.diff(first)):
        rows = order[first[s]:first[s + 1]]
        px, py = x[rows], y[rows]
        ya, yb = py.min(), py.max()
        w = np.full(len(rows), corner + float(_up(left[0], x0, y0, ya) @ left[1]))
        here = np.flatnonzero((lo <= yb + margin) & (hi >= ya - margin))
        e = x1, y1, x2, y2 = tuple(c[here] for c in edges)
        low, high, dy = lo[here], hi[here], np.where(y2 == y1, 1.0, y2 - y1)
        # where the edge runs within the strip
        xa, xb = (np.where(y1 == y2, end, (x2 - x1) * (np.clip(at_y, low, high) - y1) / dy + x1) for end, at_y in ((x1, ya), (x2, yb)))
        west, east = np.minimum(xa, xb) - margin, np.maximum(xa, xb) + margin
        meets, clear = (east >= x0) & (west <= px[-1]), west > x0
        east = np.minimum(east, px[-1] + margin)
        through = meets & clear & (low <= ya) & (high > yb)
        if through.any():
            wide = 2 * np.median((east - west)[through])
            through &= east - west <= wide
            w += _sorted_east_of(tuple(c[through] for c in e), m[here][through], west[through], wide, px, py)
        for some, count in ((meets & clear & ~through, _east_of), (meets & ~clear, None)):
            if some.any():
                part = tuple(c[some] for c in e), m[here][some]
                w += count(*part, px, py) if count else _beside(*part, x0, ya, px, py)
        out[rows] = w.astype(np.int64)
    return out
