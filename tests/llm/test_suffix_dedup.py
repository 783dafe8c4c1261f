"""Repeated byte strings against a table of all strings."""

import hashlib
import random

import brute
import numpy as np
import pytest
from townrisk.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string"


def lcp(s, i, j, cap):
    n = 0
    while n < cap and max(i, j) + n < len(s) and s[i + n] == s[j + n]:
        n += 1
    return n


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_longest_factors(letters):
    rng = np.random.default_rng(letters)
    s = rng.integers(97, 97 + letters, 300).astype(np.uint8)
    s[200:260] = s[20:80]
    for cap in (20, 32, 50):
        starts = np.arange(len(s) - cap + 1)
        earlier, later = S.longest_factors(s, starts, cap)
        for i in starts.tolist():
            assert earlier[i] == max([lcp(s, i, j, cap) for j in range(i)], default=0)
            assert later[i] == max([lcp(s, i, j, cap) for j in range(i + 1, len(starts))], default=0)


def test_anchors_follow_the_content():
    rng = random.Random(1)
    part = bytes(rng.randrange(97, 101) for _ in range(500))
    one, two = part, b"x" * 77 + part
    b = np.frombuffer(one + two, np.uint8)
    doc, place, first, last, gram, context = S.anchors(b, np.array([len(one), len(one) + len(two)]))
    inner = {(p, f, h) for d, p, f, h in zip(doc, place, first, gram, strict=True) if d == 0 and f > 0}
    assert inner <= {(p - 77, f - 77, h) for d, p, f, h in zip(doc, place, first, gram, strict=True) if d == 1}
    covered = np.zeros(301, int)
    for d, f, e in zip(doc, first, last, strict=True):
        if d == 0:
            covered[f:e + 1] += 1
    assert covered.tolist() == [1] * 301


def run(spark, rows, keep="none", schema=SCHEMA):
    got = S.remove_repeats(spark.createDataFrame(rows, schema).repartition(3), keep).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def check(spark, rows, keep="none"):
    want = brute.repeated_bytes(rows, S.LENGTH, keep == "first")
    assert run(spark, rows, keep) == sorted(
        (d if d is not None else -1, n, r, k, hashlib.sha256(b).hexdigest()) for d, n, r, k, b in want)


def corpus(seed, docs=60):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choice("abcdeé ") for _ in range(n))

    passages = [prose(n) for n in (150, 199, 205, 300, 900)]
    rows = []
    for d in range(docs):
        text = prose(rng.randrange(400))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            text += p[rng.randrange(20):] + prose(rng.choice((0, 30, 250)))
        rows.append((d, text))
    base = prose(2500)
    rows += [(1000 + i, "".join(c if rng.random() > 0.004 else "#" for c in base)) for i in range(6)]
    return rows


@pytest.mark.parametrize("keep", ["none", "first"])
def test_against_all_strings(spark, monkeypatch, keep):
    check(spark, corpus(7), keep)


def test_crowded_gram(spark, monkeypatch):
    """One passage in more texts than a block takes."""
    monkeypatch.setattr(S, "CROWD", 24)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefg ") for _ in range(260))
    rows = [(d, f"{d} " + "".join(rng.choice("abcd") for _ in range(90)) + passage + f" {d}" * 60) for d in range(S.CROWD + 40)]
    check(spark, rows)
    check(spark, rows[:S.CROWD + 5], "first")


def test_edge_cases(spark):
    long = "".join(f"{i} " for i in range(300_000))
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (6, "ab" * 150), (None, "d" * 150 + "e" * 150),
            (8, "d" * 150 + "e" * 150), (9, "é" * 100), (10, "xé" + "é" * 99 + "é")]
    check(spark, rows)
    got = run(spark, [(1, long), (2, long[5000:] + "!")])
    assert [g[2] for g in got] == [len(long) - 5000, len(long) - 5000]


def test_repeated_rows_and_empty_table(spark):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdef") for _ in range(260))
    assert [g[2:4] for g in run(spark, [(1, t), (1, t), (2, "z")])] == [(260, 1), (260, 1), (0, 0)]
    assert run(spark, []) == []
    assert run(spark, [(1, t, 3, "q")], schema=SCHEMA + ", tag int, spans string")[0][2] == 0
