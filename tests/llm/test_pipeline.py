"""The pipeline's stages against plain versions of their decisions."""

import re

import brute
import corpus_pipeline as C
from townrisk.llm import packing, secrets
from townrisk.llm.common import split_by_ids
from townrisk.session import shared_table

SF = "/root/testdata/sf0.001"
NORM = re.compile(r"[\x20\x09-\x0D]+")


def base_failed(text):
    w = [x for x in NORM.split(text or "") if x]
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i:i + 8]), []).append(i)
    hit = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(8)}
    return len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_stages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = [f for _, f in C.STAGES]
    # 200 documents have too few labels for any learned cutoff
    rows = {d: t for d, t in rows.items() if not base_failed(t)}
    out = shared_table(stages[0](spark, docs, SF), "stage")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(rows)
    seen, kept = set(), {}
    for d in sorted(rows):
        key = NORM.sub(" ", rows[d])
        if key not in seen:
            seen.add(key)
            kept[d] = rows[d]
    out = shared_table(stages[1](spark, out, SF), "stage")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(kept)
    comp = brute.near_components(sorted(kept.items()))
    kept = {d: t for d, t in kept.items() if comp[d][1] == d}
    out = shared_table(stages[2](spark, out, SF), "stage")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(kept)
    out = shared_table(stages[3](spark, out, SF), "stage")
    assert out.columns == docs.columns
    clean = {r.doc_id: r for r in out.collect()}
    assert set(clean) == set(kept)
    for d, t in kept.items():
        left = t
        for s, e in reversed(secrets.candidates(t)):
            if secrets.weak_label(t, s, e) == 1:
                left = left[:s] + "[SECRET]" + left[e:]
        assert clean[d].text == left and clean[d].n_chars == len(left)
    total = {}
    for r in stages[4](spark, out, SF).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    ids = packing.token_ids([clean[d].text.encode() for d in sorted(clean)], packing.chunk_table(packing.tokenizer_path()))
    assert total == {d: len(x) for d, x in zip(sorted(clean), ids, strict=True)}


def test_repeated_rows_and_extra_columns(spark):
    t = " ".join(f"word{k}" for k in range(40))
    rows = [(1, t, "en", "s", 1, "a"), (1, t, "en", "s", 1, "a"), (2, t.replace(" ", "\n"), "en", "s", 1, "b"), (3, None, None, None, None, None),
            (None, t + " x", "en", "s", 1, "c"), (5, "short", "en", "s", 1, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    out = shared_table(C.quality(spark, docs, SF), "stage")
    assert out.columns == docs.columns and out.count() == 4
    out = shared_table(C.exact(spark, out, SF), "stage")
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, None]
    assert C.near(spark, out, SF).columns == docs.columns
    empty = spark.createDataFrame([], docs.schema)
    for _, f in C.STAGES[:2]:
        assert f(spark, empty, SF).collect() == []


def test_exact_stage_with_an_id_on_two_texts(spark):
    docs = spark.createDataFrame([(0, "b"), (1, "a"), (1, "b"), (1, "a")], "doc_id long, text string")
    assert sorted(tuple(r) for r in C.exact(spark, docs, SF).collect()) == [(0, "b"), (1, "a")]


def test_rows_are_split_by_ids_without_a_shuffle_of_texts(spark):
    rows = spark.createDataFrame([(k if k else None, "x" * (k % 9)) for k in range(40_000)], "doc_id long, text string")
    for wanted in ([None, *range(5, 40_000, 13)], [7], []):
        sure, others = split_by_ids(rows, "doc_id", spark.createDataFrame([(k,) for k in wanted], "i long"))
        a, b = [r.doc_id for r in sure.collect()], [r.doc_id for r in others.collect()]
        assert sure.columns == others.columns == rows.columns
        assert sorted(x or 0 for x in a + b) == list(range(40_000))
        assert set(wanted) <= set(b) and len(b) < 1.2 * len(wanted) + 2000
        assert "Exchange hash" not in sure._jdf.queryExecution().executedPlan().toString()


def test_stages_move_no_texts_that_stay(spark):
    """The joins back to the documents shuffle the texts of few rows: those that may go or have findings."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (C.exact, C.near, C.secrets):
        plan = stage(spark, docs, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan and "_bits" in plan
