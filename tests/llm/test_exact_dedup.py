"""Exact deduplication: recipes against plain comparison, also with colliding fingerprints."""

import hashlib
import random
import re

import pytest
from townrisk.llm import exact_dedup as X

SCHEMA = "doc_id long, text string"
NORM = re.compile(r"[\x20\x09-\x0D]+")


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(NORM.sub(" ", t or ""), []).append(d)
    out = []
    for d, t in rows:
        n = NORM.sub(" ", t or "")
        keep = min((x for x in groups[n] if x is not None), default=None)
        out.append((d, keep, len(groups[n]), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, schema=SCHEMA, **kw):
    out = X.exact_dedup(spark.createDataFrame(rows, schema), **kw)
    return sorted((tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def corpus():
    rng = random.Random(3)
    base = [" ".join(rng.choice(("la me", "be mi do", "tre", "ka")) for _ in range(rng.randrange(60))) for _ in range(12)]
    rows = [(k, rng.choice(base).replace(" ", rng.choice((" ", "  ", "\n\t")))) for k in range(80)]
    return rows + [(900, base[0] + "!"), (901, "x" * 20_000), (902, "x" * 20_000), (903, "x" * 19_999), (904, "é " * 5000)]


@pytest.mark.parametrize("kw", [{}, {"fingerprint": "xxhash64(chunk) % 3", "shortest": 2, "longest": 12},
                                {"fingerprint": "0L", "shortest": 4, "longest": 9}])
def test_recipes_equal_plain_comparison(spark, kw):
    rows = corpus()[:40 if kw else None]
    if kw:
        rows = [(d, t[:60]) for d, t in rows]
    assert got(spark, rows, **kw) == plain(rows)


def test_chunks_rebuild_the_text(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    for r in X.chunked(df).collect():
        assert "".join(r.chunks) == r.norm and all(len(c) <= X.MAX_CHUNK for c in r.chunks)
    long = " ".join(f"ba le mo {k}" for k in range(3000))
    cut = {r.doc_id: r.chunks for r in X.chunked(spark.createDataFrame([(1, long), (2, "new start " + long)], SCHEMA)).collect()}
    assert len(cut[1]) > 10 and len(set(cut[1]) & set(cut[2])) > len(cut[1]) / 2  # cuts follow the content


def test_edge_cases(spark):
    rows = [(3, None), (2, ""), (5, " "), (4, "a"), (4, "a"), (None, "a"), (None, "b"), (7, "a\x0bb"), (6, "a b"), (8, "a b")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []
    wide = [(1, "q", "x", 2), (0, "q", "y", 3)]
    assert got(spark, wide, SCHEMA + ", ids string, keep_id int") == plain([r[:2] for r in wide])
