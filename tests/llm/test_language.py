"""Language identification: held-out accuracy, hierarchy, edge cases."""

import random
import zlib

import numpy as np
from townrisk.llm import language as L

SCHEMA = "doc_id long, text string, lang string"


def test_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95


def test_machine_and_hierarchy():
    rng = random.Random(1)
    kinds = {"en": "the ing th", "de": "sch ung ein", "fr": "eau ais ou", "es": "ado cion os", "xx": "zzq qqz"}
    texts = [(lang, " ".join(rng.choice(p.split()) for _ in range(rng.randrange(5, 60)))) for lang, p in kinds.items() for _ in range(40)]
    x, y = L.vectors([t for _, t in texts]), np.array([lang for lang, _ in texts], dtype=object)
    assert np.allclose((x ** 2).sum(axis=1), 1, atol=1e-4)
    model = L.Hierarchy(x[::2], y[::2])
    assert model.top.classes == ["=xx", "germanic", "romance"] and [m.classes for m in model.inner] == [["xx"], ["de", "en"], ["es", "fr"]]
    lang, score = model.predict(x[1::2])
    assert lang == y[1::2].tolist() and score.min() > 0 and score.max() <= 1


def test_vectors_do_not_depend_on_neighbours():
    texts = ["ab cé", "", "x" * 3_000_00, "ab cé", "123 !"]
    x = L.vectors(texts)
    assert np.array_equal(x[0], x[3]) and not x[1].any() and not x[4].any()
    assert np.array_equal(L.vectors(texts[2:3])[0], x[2])


def test_edge_cases(spark):
    rows = [(k, "the thing ing", "en") for k in range(8)] + [(20, None, "en"), (21, "", None), (22, "12 ! ⅷ3", "en"), (23, "é", None),
                                                             (None, "words", "en"), (20, None, "en")]
    df = spark.createDataFrame([(*r, 1.0, "y") for r in rows], SCHEMA + ", score double, held_out string")
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[20] == by[21] == by[22] == "und" and by[23] == "en" and by[None] == "en"
    assert L.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.lang_pred for r in L.identify(spark.createDataFrame([(1, "abc", None)], SCHEMA)).collect()] == ["und"]
