"""Token files: ids against the tokenizers library, order and places, views of equal-length sequences."""

import random
import zlib

import numpy as np
import pytest
from townrisk.llm import token_files as T
from townrisk.llm.packing import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["", " ", "  ", "a  b", " a", "a ", "it's we'll 'tis", "say <|endoftext|> now", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>",
       "one\ntwo\n\nthree .\n four", "tab\tand nbsp", "ogham mark", "a\x1cb c\x1d d", "123 4,5.6 ...,, !?", "naïve Straße ñandú",
       "日本語 テスト", "😀 😀😀", "end.\nThat's", "word" * 300, "é ́e", "᠎ x ᠎", "  y", "a​ b", "\x85 \x85z"]


def test_ids_equal_the_library(tokenizer):
    rng = random.Random(5)
    bits = ["a", "Z", "'s", "'", " ", "  ", "\n", ".", ",", "7", "é", "ß", " ", "-", "<|endoftext|>", "\t", "中", "!", "l", "re"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(600)]
    e = T.Encoder(tokenizer_path())
    for t in texts + texts:
        assert np.frombuffer(b"".join(e.pieces(t)), e.dtype).tolist() == ids_of(tokenizer, t)[:-1], repr(t)


def test_a_full_table_and_slices(tokenizer, monkeypatch):
    monkeypatch.setattr(T, "WORDS", 20)
    monkeypatch.setattr(T, "SLICE", 40)
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abc.,\n") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    e = T.Encoder(tokenizer_path())
    for t in (text, text[::-1], "no_blank_at_all" * 50):
        assert np.frombuffer(b"".join(e.pieces(t)), e.dtype).tolist() == ids_of(tokenizer, t)[:-1]
        assert len(e.words) <= 20 and len(e.parts) <= 20


def test_files_hold_documents_in_order(spark, tmp_path, tokenizer, monkeypatch):
    rows = [(k * 7 % 101, ODD[k % len(ODD)]) for k in range(101)] + [(200, "long text " * 5000), (201, None), (None, "nobody"), (5, ODD[3]), (5, "other")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", _lit("x")).withColumn("path", _lit("y"))
    files = T.write_token_files(docs.repartition(4), str(tmp_path / "f"), sequence=16, roll=800)
    assert files.count() > 3
    got = T.read_token_files(files).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (d is not None, d or 0, len(i), crc(i)) for d, t in rows for i in [ids_of(tokenizer, t)])
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)


def _lit(x):
    from pyspark.sql import functions as F
    return F.lit(x)


def test_sequences_are_views(spark, tmp_path, tokenizer):
    rows = [(k, f"document {k} with some words " * (k % 40)) for k in range(400)]
    files = T.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "f"), sequence=32).collect()
    stream = [i for _, t in rows for i in ids_of(tokenizer, t)]
    for f in sorted(files, key=lambda f: f.start):
        data = T.TokenFile(f.path)
        assert len(data) == f.sequences == -(-f.ids // 32)
        for i in (0, len(data) // 2, len(data) - 1):
            ids, mask = data[i]
            assert not ids.flags.owndata and len(ids) == len(mask) == 32
            low, size = data.file.get_batch(i // T.BATCH).column(1).flatten().buffers()[1].address, T.BATCH * 4
            assert low <= mask.buffers()[1].address < low + size  # bits of the mapped file
            n = min(32, f.ids - 32 * i)
            assert mask.to_pylist() == [True] * n + [False] * (32 - n)
            assert ids[:n].tolist() == stream[f.start + 32 * i:f.start + 32 * i + n]
        with pytest.raises(IndexError):
            data[len(data)]


def test_one_id_for_all_rows_is_spread(spark, tmp_path):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'same text' as text")
    files = T.write_token_files(docs, str(tmp_path / "f"))
    assert files.count() > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    got = T.read_token_files(files)
    assert got.count() == 4000 and got.select("start").distinct().count() == 4000


def test_empty_table(spark, tmp_path):
    got = T.token_files_report(spark.createDataFrame([], "doc_id long, text string"), folder=str(tmp_path / "f"))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0


def test_plain_words_need_no_pattern(monkeypatch):
    """Words between plain spaces are cut without the pattern; with odd blanks the ids still are the library's."""
    e = T.Encoder(tokenizer_path())
    monkeypatch.setattr(T, "SLICE", 40)
    rng = random.Random(11)
    bits = ["word", "two,", "Été", "x1", "\n", " ", "  ", "\t", "᠎", " ", "　", "don't", "語", "a\nb", "end.\n", "1234567", ""]
    for _ in range(1500):
        text = rng.choice([" ", ""]).join(rng.choices(bits, k=rng.randrange(30))) + rng.choice(["", "\n", " "])
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(e.pieces(text)), e.dtype).tolist() == want, repr(text)

    class Cut:
        search = T._CUT.search

        def split(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(T, "_CUT", Cut())
    text = "Plain words, one\nline end; " * 20 + "and a last one.\n"
    assert np.frombuffer(b"".join(e.pieces(text)), e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_new_words_are_letters_and_marks():
    """Words of Latin letters go to the model as they are, whatever marks and line ends follow; the whole tokenizer sees none of them."""
    e = T.Encoder(tokenizer_path())
    rng = random.Random(12)
    bits = ["word", "Été", "über", "ÿÀ", "the", "x", ".", ",", "$$$", "***", "###", "&&&", "%", "\n", "!?", ".\n", " ", "'s", "'", "1", "<|endoftext|>", "×", "é", "(", "\t"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randrange(14)))
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(e.pieces(text)), e.dtype).tolist() == want, repr(text)
    text = "une Été,\nviè$$$ über\nand *** thée.\nÀ, end%% "
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    e, asked = T.Encoder(tokenizer_path()), []

    class Whole:
        def encode(self, part, **options):
            asked.append(part)
            return tokenizer.encode(part, **options)

    tokenizer, e.tokenizer = e.tokenizer, Whole()
    assert np.frombuffer(b"".join(e.pieces(text)), e.dtype).tolist() == want
    assert not any(c.isalpha() for part in asked for c in part), asked


def test_words_met_again_outlast_a_full_table(monkeypatch):
    monkeypatch.setattr(T, "WORDS", 100)
    made = []

    def make(text):
        made.append(text)
        return text.encode()

    known = T._Known(make)
    for k in range(1000):
        assert known[f"new{k}"] == b"new%d" % k and known["often"] == b"often"
        assert len(known) + len(known.aside) <= 100
    assert made.count("often") == 1
