"""Plain-Python exact geometry used as a brute-force reference in tests."""

from __future__ import annotations


def shoelace(poly):
    s = 0.0
    for i in range(len(poly)):
        x1, y1 = poly[i]
        x2, y2 = poly[(i + 1) % len(poly)]
        s += x1 * y2 - x2 * y1
    return s / 2.0


def clip(subject, convex):
    """Sutherland-Hodgman: subject (any simple ring) clipped by a convex CCW ring."""
    out = list(subject)
    n = len(convex)
    for i in range(n):
        ax, ay = convex[i]
        bx, by = convex[(i + 1) % n]
        inp, out = out, []
        if not inp:
            break

        def side(p):
            return (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)

        for j in range(len(inp)):
            p, q = inp[j], inp[(j + 1) % len(inp)]
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def overlay(subject, convex):
    c = clip(subject, convex)
    return abs(shoelace(c)) if len(c) >= 3 else 0.0


def union_overlay(subject, convexes):
    """area(subject n union(convexes)) by inclusion-exclusion (pruned)."""
    total = 0.0
    idx = list(range(len(convexes)))

    def rec(start, cur, k):
        nonlocal total
        for i in idx[start:]:
            nxt = clip(cur, convexes[i])
            a = abs(shoelace(nxt)) if len(nxt) >= 3 else 0.0
            if a <= 1e-12:
                continue
            total += a if (k + 1) % 2 == 1 else -a
            rec(i + 1, nxt, k + 1)

    rec(0, list(subject), 0)
    return total


def inside(px, py, ring):
    c = 0
    n = len(ring)
    for i in range(n):
        x1, y1 = ring[i]
        x2, y2 = ring[(i + 1) % n]
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            c += 1
    return c % 2 == 1

