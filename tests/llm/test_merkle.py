"""Merkle manifest against a plain tree, for every group size and fan, odd rows, and tampering."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from townrisk.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level, fan):
    """(root, for each start node its (left, right) of every level)."""
    steps = [[] for _ in level]
    under = [[i] for i in range(len(level))]
    while len(level) > 1:
        runs = [range(k, min(k + fan, len(level))) for k in range(0, len(level), fan)]
        for run in runs:
            for i in run:
                for leaf in under[i]:
                    steps[leaf].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        under = [[x for j in run for x in under[j]] for run in runs]
        level = [h(*(level[j] for j in run)) for run in runs]
    return level[0], steps


def plain(rows, fan=2):
    rows = sorted(rows, key=lambda r: ((r[2] is not None), (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf_of(r)))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: (r[2] is not None, r[2]))]
    trees = [climb([leaf_of(r) for r in g], fan) for g in groups]
    root, above = climb([t[0] for t in trees], fan)
    out = []
    for g, (sub, steps), up in zip(groups, trees, above, strict=True):
        for r, s in zip(g, steps, strict=True):
            path = s + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            cur = leaf_of((*r[:3], r[3] + 1, r[4])) if hit else leaf_of(r)
            for left, right in path:
                cur = h(left, cur, right)
            out.append((r[0], leaf_of(r), sub, root, h(*(x for p in path for x in p)), cur, cur == root))
    return out


def rows_of(sizes, seed=0):
    rng = random.Random(seed)
    out, at = [], 0
    for lang, n in sizes:
        for _ in range(n):
            out.append((at, rng.choice(("web", "hot", None)), lang, rng.choice((None, 0, 17, 2 ** 63 - 1)),
                        rng.choice(("", None, "text", "ünïcode", "x" * rng.randrange(300)))))
            at += rng.randrange(1, 4)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("fan,levels,sizes", [
    (2, 2, [("de", 1), ("en", 37), ("fr", 4), (None, 5), ("", 2), ("é", 16), ("z", 17), ("zz", 3)]),
    (2, 8, [("en", 700), ("de", 257), (None, 256)]),
    (3, 2, [("a", 1), ("b", 2), ("c", 9), ("d", 10), ("e", 28), ("f", 82)]),
    (2, 3, [("only", 23)]),
    (2, 8, [("one", 1)]),
])
def test_against_a_plain_tree(spark, fan, levels, sizes):
    rows = rows_of(sizes, fan * 100 + levels)
    got = M.manifest_report(spark.createDataFrame(rows, SCHEMA).repartition(3), fan, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(got) == sorted(plain(rows, fan))
    assert {r[0] for r in got if not r[-1]} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None}


def test_repeated_and_null_keys(spark):
    rows = [(None, "s", "en", 1, "a"), (None, "s", "en", 1, "a"), (7, "s", "en", 1, "b"), (7, "s", "en", 1, "a"), (7, "s", "en", 1, "a"),
            (7, None, None, None, None), (-3, "-", "en", 1, ""), (-3, None, "en", 1, "1:x"), *[(50, "hot", "en", 2, "same")] * 40,
            (51, "t", "en", 9, "long " * 200_000)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' as leaf", "1 as root", "2 as _n", "3 as _digest", "4 as tampered")
    got = [tuple(r) for r in M.manifest_report(docs, 2, 3).collect()]
    key = lambda r: (r[0] is not None, r)
    assert sorted(got, key=lambda r: str(key(r))) == sorted(plain(rows), key=lambda r: str(key(r)))


def test_fields_do_not_run_together(spark):
    rows = [(1, "a", "b", 1, "c"), (1, "a1", "b", 1, "c"), (1, None, "b", 1, "c"), (1, "-", "b", 1, "c"), (1, "", "b", 1, "c")]
    got = M.manifest_report(spark.createDataFrame(rows, SCHEMA))
    assert got.select("leaf").distinct().count() == 5


def test_any_changed_leaf_or_sibling_breaks_the_root(spark):
    from pyspark.sql import functions as F
    rows = rows_of([("en", 21), ("de", 6)], 3)
    leaves = spark.createDataFrame(rows, SCHEMA).select("doc_id", "lang", M.row_hash([F.col(c) for c in M.COLUMNS]).alias("leaf"))
    m = M.manifest(leaves, "lang", "doc_id", "leaf", levels=2)
    swapped = F.expr("transform(_steps, (s, i) -> if(i = 1, named_struct('l', s.r, 'r', s.l), s))")
    other = m.select(M.folded("_steps", "leaf").alias("ok"), M.folded("_steps", "sha2('x', 256)").alias("leaf_changed"),
                     swapped.alias("sw"), "leaf", "_root", "_steps").withColumn("swapped", M.folded("sw", "leaf"))
    assert other.filter("ok <> _root or leaf_changed = _root").count() == 0
    assert other.filter("_steps[1].l <> _steps[1].r and swapped = _root").count() == 0


def test_empty_table(spark):
    assert M.manifest_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_stay_inside_blocks(spark):
    """Every window is dealt by group and block, never by the group alone."""
    nodes = spark.range(2000).selectExpr("'g' as _group", "id as _pos", "2000L as _n", "sha2(string(id), 256) as _digest")
    plan = M.climb(nodes, 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "_block" in plan[plan.index("Exchange hashpartitioning"):][:120]
