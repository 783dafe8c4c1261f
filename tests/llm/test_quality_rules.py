"""Quality rules: measures against plain counts, exact binomial tests, admitted cutoffs."""

import math
import random
import re

from pyspark.sql import functions as F
from townrisk.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = [x for x in BLANK.split(text) if x]
    lines = [x for x in text.split("\n") if BLANK.sub("", x)]
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i:i + 8]), []).append(i)
    hit = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit))


def test_measures(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a b c d e f g h", "a " * 40, "é# |\n\nx\n x\nx\n", "w " * 20_000, "z" * 50_000]
    texts += [" ".join(rng.choice("abc") + rng.choice((" ", "\n", "#")) for _ in range(rng.randrange(120))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], SCHEMA).withColumn("words", F.lit(1))
    for r in Q.measures(df).collect():
        assert tuple(r[2:]) == plain(texts[r.doc_id]) and r.stratum == ""


def test_binomial_tail_is_exact(spark):
    cases = [(n, k, p) for n in (1, 30, 400, 5000) for k in (0, 1, 3, 15) for p in (0.004, 0.05) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long, p double").withColumn("t", F.expr(Q.binomial_tail("k", "n", "p")))
    for r in df.collect():
        want = 1.0 if r.k >= r.n * r.p else sum(
            math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(r.p)
                     + (r.n - i) * math.log(1 - r.p)) for i in range(r.k + 1))
        assert abs(r.t - want) < 1e-9


def test_cutoffs_follow_the_labels(spark):
    """With enough clean good documents the strictest cutoff is admitted; a stratum without labels gets none."""
    good = [(k, " ".join(f"word{(k * 7 + j) % 997}" for j in range(30)), "en") for k in range(3000)]
    odd = [(9000, "#word " * 1 + " ".join(f"a{j}###" for j in range(30)), "en"), (9001, " ".join(f"a{j}###" for j in range(30)), "xx"),
           (9002, "short text", "en"), (9003, None, None)]
    docs = spark.createDataFrame(good + odd, SCHEMA)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(3000)] + [(5, 1, 1), (9000, 0, 0), (77777, 1, 0), (9003, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.quality_rules(docs, labels).collect()}
    assert len(got) == len(good) + len(odd) and all(got[k].kept for k in range(3000))
    assert not got[9000].kept and "symbols" in got[9000].failed_rules and not got[9000].base_failed
    assert got[9001].kept and got[9002].base_failed and not got[9002].kept and got[9003].base_failed
    cuts = Q.thresholds(Q.measures(docs), labels).collect()
    assert [(r.stratum, r.cut_symbols) for r in cuts] == [("en", 0.02)]
    kept = Q.quality_filtered(docs.withColumn("_x", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "_x"] and kept.count() == sum(r.kept for r in got.values())


def test_too_few_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, " ".join(f"a{j}###" for j in range(30)), "en") for k in range(9)], SCHEMA)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in Q.quality_rules(docs, labels).collect())
    none = spark.createDataFrame([], SCHEMA)
    assert Q.quality_rules(none, labels).collect() == []
    assert len(Q.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()) == 9
