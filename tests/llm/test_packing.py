"""Packing: ids against the tokenizer itself, every id in one piece, little padding."""

import random
import zlib

import numpy as np
import pytest
from townrisk.llm import packing as P
from townrisk.llm.chunks import ChunkTable

ODD = ["", " ", "a b", "  a  b \n c", "a b   c", "é è　 x", "漢字 漢 字", "it's don't 'S 've x's",
       "<|endoftext|> a", "say <|endoftext|> now", "x<|endoftext|>y<|endoftext|>", "a  ", " a ", "\u0085 a", "x ​ y", "q" * 3000 + " z", "a \x1c b", "𝔘 𝔘 b", "1 2 33 a1",
       "the " * 20000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.tokenizer_path())  # as it stands in the file: an added token's text is that token


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(" \n\t'sab1.é漢 　’") for _ in range(rng.randrange(40))) for _ in range(600)]
    table = ChunkTable(P._encode_chunks(P.tokenizer_path()), slots=1 << 8, pool=1 << 12)
    for _ in range(2):
        got = P.token_ids([t.encode() for t in texts], table)
        for t, ids in zip(texts, got, strict=True):
            assert ids.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], t[:50]


def thue_morse(a, b, n=10):
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_texts_of_one_hash_keep_their_ids(tokenizer):
    """The two Thue-Morse strings of 1,024 letters have the same polynomial hash modulo 2^64."""
    texts = [t for pair in ("ab", "xy", "é!") for t in thue_morse(*pair)]
    for order in (texts, texts[::-1], texts + texts):
        table = ChunkTable(P._encode_chunks(P.tokenizer_path()), slots=1 << 8, pool=1 << 12)
        for group in (order, [t for o in order for t in (o + " " + o,)]):
            for t, ids in zip(group, P.token_ids([t.encode() for t in group], table), strict=True):
                assert ids.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


def check_sequences(pieces, lengths, window, groups=1):
    """pieces: (doc, start, length, sequence, offset)."""
    by_doc, by_seq = {}, {}
    for d, s, n, q, o in pieces:
        by_doc.setdefault(d, []).append((s, n))
        by_seq.setdefault(q, []).append((o, n))
    assert set(by_doc) == set(lengths)
    for d, spans in by_doc.items():
        at = 0
        for s, n in sorted(spans):
            assert s == at and n > 0
            at += n
        assert at == lengths[d]
    padding = 0
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("max_open", [5, 4096])
def test_placing(max_open):
    rng = random.Random(max_open)
    s = P.SumOfSquares(64, max_open)
    lengths = {d: rng.choice((33, rng.randrange(1, 64))) for d in range(800)}
    for d, n in lengths.items():
        s.add((d, 0, np.zeros(n, np.uint16), n))
        assert s.count.sum() <= max_open and s.count[1:64].tolist() == [len(x) for x in s.open[1:]]
    s.pour()
    pieces = []
    for q, held in enumerate(s.closed):
        o = 0
        for d, start, ids, _ in held:
            pieces.append((d, start, len(ids), q, o))
            o += len(ids)
    assert check_sequences(pieces, lengths, 64) == 0


def test_level_rule():
    s = P.SumOfSquares(10)
    for n in (4, 4, 6):
        s.add((n, 0, np.zeros(n, np.uint16), n))
    # 4, then 4 onto it would leave one window of 8 (sum 1) against two of 4 (sum 4); then 6 needs a new window
    assert s.count.tolist() == [0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0]
    s.add((0, 0, np.zeros(2, np.uint16), 2))  # closes the window of 8: only the 6 is left
    assert len(s.closed) == 1 and s.count[6] == 1


def test_query_rows(spark, tokenizer):
    texts = [(k, t) for k, t in enumerate(ODD)] + [(500, None), (501, "a b"), (502, "a b")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 as start", "'x' as ids_crc32")
    rows = P.pack(df.repartition(3)).collect()
    full = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in texts}
    assert check_sequences([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows],
                           {d: len(x) for d, x in full.items()}, 1024) == 0
    for r in rows:
        assert r.doc_tokens == len(full[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(full[r.doc_id][r.start:r.start + r.length].tobytes())


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
