"""Centroid clustering against a full search in Python integers; bounds never above the truth."""

import hashlib
import math
import random

import numpy as np
import pytest
from townrisk.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=16, rounds=3, dim=64):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in e]))
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cs = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(cs)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    total = {}
    for _, j, d in found:
        total[j] = total.get(j, 0) + d
    return [(i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, d in found]


def report(spark, rows, **options):
    return C.clusters_report(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cluster", "2 as v", "3 as near").repartition(3), **options)


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def vectors(n, seed, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    return [(i, [m + rng.gauss(0, spread) for m in rng.choice(middles)]) for i in range(n)]


def test_against_a_full_search(spark):
    rows = vectors(400, 1, 0.3)
    got = report(spark, rows)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same(got, plain(rows))


def test_odd_rows(spark):
    rows = vectors(30, 2)
    good = rows[0][1]
    rows += [(100, None), (101, []), (102, good[:63]), (103, good + [0.0]), (104, [None] + good[1:]), (105, [math.nan] + good[1:]),
             (106, [math.inf] + good[1:]), (107, [-math.inf] + good[1:]), (None, good), (None, rows[1][1]), (3, good), (3, good),
             (200, [-0.0] * 64), (201, [1e-30] * 64), (202, [-1e-30] * 64), (203, [2.0 ** 20] * 64)] + [(k, good) for k in range(300, 340)]
    same(report(spark, rows), plain(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 15, 17])
def test_few_vectors(spark, n):
    rows = vectors(n, 3)
    same(report(spark, rows), plain(rows))


def test_all_equal_and_ties(spark):
    same(report(spark, [(i, [0.5] * 64) for i in range(40)]), plain([(i, [0.5] * 64) for i in range(40)]))
    rng = random.Random(4)  # few distinct places on a grid: many equal distances
    rows = [(i, [float(rng.randrange(2)) if j < 3 else 0.0 for j in range(64)]) for i in range(200)]
    same(report(spark, rows), plain(rows))


def test_far_components_stop_the_job(spark):
    with pytest.raises(Exception, match="a component beyond"):
        report(spark, [(1, [3e6] + [0.0] * 63)]).collect()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    middles = rng.integers(-3000, 3000, (16, 64))
    v = middles[rng.integers(0, 16, 4000)] + rng.integers(-150, 150, (4000, 64))
    for centroids in (middles, v[:16], v[:16] * 40_000):
        x = v if centroids is not v[:16] else v
        pivots = C.distant(centroids, 6)
        s = C.Search(centroids, pivots)
        kept = C.pivot_distances(x, pivots)
        low = s.bounds(kept)
        exact = np.stack([C.squares(x, c) for c in centroids], axis=1)
        assert (low <= exact).all()
        which, best = s.nearest(x, kept)
        assert (best == exact.min(axis=1)).all() and (which == exact.argmin(axis=1)).all()
    s = C.Search(middles, C.distant(middles, 6))
    s.nearest(v, C.pivot_distances(v, C.distant(middles, 6)))
    assert s.checked < 0.5 * len(v) * 16  # most are pruned where clusters lie apart
