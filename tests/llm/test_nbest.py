"""N-best encoding against all segmentations of the whole text; exact decoding."""

import random

import numpy as np
import pytest
from townrisk.llm import nbest as B


@pytest.fixture(scope="module")
def v():
    return B.vocabulary(B.model_path())


def all_paths(v, word):
    """Every segmentation of ``word``: (score, ids)."""
    memo = {0: [(0.0, ())]}
    for end in range(1, len(word) + 1):
        if B._node(word, end):
            memo[end] = [(s + score, ids + more) for start, more, score in v.edges(word, end) for s, ids in memo[start]]
    return memo[len(word)]


def ids_score(v, ids):
    total, pending = 0.0, 0
    by_id = {i: s for i, s in v.piece.values()}
    for i in ids:
        if i in by_id:
            total += by_id[i]
        else:
            b = v.bytes[i][0]
            total += v.unknown if b & 0xC0 != 0x80 else 0
    return total


@pytest.mark.parametrize("n", [1, 2, 5])
def test_against_all_segmentations(v, n):
    rng = random.Random(n)
    texts = ["", " ", "a", "  a  b", "the\n cat", "é\tñ x", "▁a ▁", "𝔘𝔘", "abc abc", "ab ab ab"]
    texts += ["".join(rng.choice("theran é\n▁漢 ") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    got = B.encode_texts([t.encode() for t in texts], B.model_path(), n)
    for t, ranked in zip(texts, got, strict=True):
        b = t.encode()
        want = sorted((s for s, _ in all_paths(v, b" " + b)), reverse=True)[:n] if b else [0.0]
        assert [s for s, _ in ranked] == pytest.approx(want), t
        assert len({tuple(i) for _, i in ranked}) == len(ranked)
        for s, ids in ranked:
            assert B.decode(v, ids) == b
            assert ids_score(v, ids.tolist()) == pytest.approx(s)


def test_many_words_at_once_equal_single_words(v):
    rng = random.Random(9)
    words = [bytes(rng.choice(" theran,.".encode()) for _ in range(7)) for _ in range(200)]
    words += [("é漢" + rng.choice("abé") + "xq").encode()[:] for _ in range(6)]
    lens, flat, x = B.word_encoder(v)(words)
    ends = np.cumsum(lens)
    for k, w in enumerate(words):
        ids, best, gap = B._one(v, w)
        assert flat[ends[k] - lens[k]:ends[k]].tolist() == ids and x[k].tolist() == [best, gap]


def test_long_word_and_rows(spark, v):
    rows = [(1, "x" * 8_000), (2, None), (3, ""), (4, "one two"), (4, "one two"), (None, "q")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, nbest string")
    got = B.encode(df, 2).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id) or ""
        assert all(B.decode(v, np.array(p.ids, np.int64)) == text.encode() for p in r.nbest)
    report = B.encoding_report(df).collect()
    assert all(r.decoded_equal for r in report) and {r.doc_id: r.n_pieces for r in report}[2] == 0
    assert B.encoding_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
