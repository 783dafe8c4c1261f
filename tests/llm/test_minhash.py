"""MinHash near-duplicates against all pairs."""

import random

import brute
import numpy as np
from townrisk.llm import minhash as M
from townrisk.llm.textcore import normal_words, shingle_set, word_hashes

SCHEMA = "doc_id long, text string"


def run(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return {r.doc_id: r for r in M.near_duplicates(df).collect()}


def check(spark, rows):
    got = run(spark, rows)
    want = brute.near_components(rows)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def edited(rng, base, rate):
    return " ".join(w + "x" if rng.random() < rate else w for w in base)


def test_kernels():
    text = ("Ab cé\td\n" * 300 + "x" * 5000).encode()
    assert len(shingle_set(normal_words(text))) == len(brute.shingles(text.decode()))
    assert len(word_hashes(normal_words(text))) == len(brute.words(text.decode()))


def test_long_word(monkeypatch):
    import townrisk.llm.textcore as T
    monkeypatch.setattr(T, "PIECE", 64)
    T.powers.cache_clear(), T.inverse_powers.cache_clear()
    w = T.word_hashes(b"a " * 100 + b"y" * 300 + b" a b " .rstrip())
    assert len(w) == 103 and w[0] == w[101] and w[100] not in (w[0], w[102])
    T.powers.cache_clear(), T.inverse_powers.cache_clear()


def test_posterior_bound():
    assert [M.least_matches(n) < 0.75 * n for n in M.BATCHES] == [True] * len(M.BATCHES)
    a = np.zeros((2, M.HASHES), "<u2")
    b = a.copy()
    b[1, ::2] = 1
    assert list(M.survivors(a, b)[0]) == [0]


def test_hot_group_of_near_copies(spark):
    """A star around one leader is not enough here: members are often under the threshold with each other."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [(i, edited(rng, base, rng.choice((0.01, 0.02, 0.035, 0.06)))) for i in range(150)]
    other = [f"v{rng.randrange(900)}" for _ in range(120)]
    rows += [(1000 + i, " ".join(other[:60] + [f"u{i}_{k}" for k in range(12 * (i % 3))])) for i in range(30)]
    check(spark, rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, "one two three"),
            (7, "a b c d e"), (8, "A b c d e"), (9, "a b c d e f"), (10, "w " * 9000), (11, "w " * 5)]
    check(spark, rows)


def test_table_sample(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == {}
    got = run(spark, [(1, "a b", 5, "x"), (2, "a  B", 6, "y")], SCHEMA + ", n long, component_id string")
    assert got[2].component_id == 1


def thue_morse(letters, n=1024):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_thue_morse_words(spark):
    """Two words that differ in every letter have the same polynomial modulo 2 ** 64."""
    x, y = thue_morse("ab"), thue_morse("ba")
    assert len(set(word_hashes(f"{x} {y}".encode()).tolist())) == 2
    head = "one two three four five six seven eight nine ten"
    check(spark, [(1, x), (2, y), (3, f"{head} {x}"), (4, f"{head} {y}"), (5, f"{x} {y} {x} {y} {x} {y} {y}")])


def test_words_longer_than_a_piece(monkeypatch):
    """A word has one hash, whatever path takes it."""
    import townrisk.llm.textcore as T
    word = b"k" * 30 + b"z" * 34
    short = T.word_hashes(word)[0]
    monkeypatch.setattr(T, "PIECE", 16)
    assert T.word_hashes(b"a " + word + b" b c d e f g h i j k l")[1] == short


def test_exact_shingles():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 40, 40)]
    got = M.exact_shingles([t.encode() for t in texts])
    want = [brute.shingles(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i, x in enumerate(got):
        for j, y in enumerate(got):
            assert len(set(x.tolist()) & set(y.tolist())) == len(set(want[i]) & set(want[j])), (i, j)
