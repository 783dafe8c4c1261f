"""Reads of few keys: trigram search and tables laid out by key."""

import random
from glob import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from townrisk.operators import search as G
from townrisk.sources.staging import clustered


def scanned(df):
    """Rows that the Parquet scans of ``df`` hand on."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            p = p.executedPlan()
        if "QueryStage" in p.getClass().getSimpleName():
            p = p.plan()
        if p.nodeName().startswith("Scan parquet"):
            total += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return total


def small_groups(rows):
    return {"parquet.block.size": "1024", "parquet.page.size.row.check.min": str(rows), "parquet.block.size.row.check.min": str(rows),
            "parquet.page.size.row.check.max": str(rows), "parquet.block.size.row.check.max": str(rows), "parquet.page.row.count.limit": str(rows)}


def test_search_against_contains(spark):
    rng = random.Random(11)
    names = [(i, "".join(rng.choice("abc丁") for _ in range(rng.choice((0, 1, 2, 3, 5, 9))))) for i in range(400)]
    names += [(400, None), (401, "aaaaaaaa"), (402, "a.*c"), (403, "丁")]
    df = spark.createDataFrame(names, "key long, search_key string")
    index = clustered(G.trigram_rows(df), "test-grams", ["gram", "key"])
    counts = clustered(G.gram_counts(index), "test-counts", ["gram"])
    for q in ("a", "丁", "ab", "aa", "aaa", "abc", "a.*", ".*", "b丁a", "abca", "aaaaaaaa", "zzz", "ab丁cab"):
        got = sorted(r["key"] for r in G.containing(index, counts, q).collect())
        assert got == [k for k, s in names if s is not None and q in s], q


def test_search_reads_the_rows_of_its_trigram(spark):
    names = spark.range(20000).select(F.col("id").alias("key"), F.concat(F.lit("town"), F.col("id").cast("string")).alias("search_key"))
    index = clustered(G.trigram_rows(names), "test-grams", ["gram", "key"], options=small_groups(1000))
    counts = clustered(G.gram_counts(index), "test-counts", ["gram"])
    found = G.containing(index, counts, "town1777")
    assert "StartsWith" not in (plan := found._jdf.queryExecution().toString()) and "EqualTo(gram" in plan
    assert [r["key"] for r in found.collect()] == [1777, *range(17770, 17780)]
    assert scanned(found) < index.count() / 10


def test_one_key_reads_one_row_group(spark):
    rows = spark.range(30000).select((F.col("id") * 2).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table = clustered(rows.repartition(7), "test-mart", ["key"], options=small_groups(1000))
    path = table.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    metas = [pq.ParquetFile(f).metadata for f in glob(f"{path}/*.parquet")]
    groups = [m.row_group(k) for m in metas for k in range(m.num_row_groups)]
    bounds = [(g.column(0).statistics.min, g.column(0).statistics.max, g.num_rows) for g in groups]
    assert len(groups) >= 20
    hold = [n for lo, hi, n in bounds if lo <= 31416 <= hi]
    one = table.where(F.col("key") == 31416)
    assert len(hold) == 1 and one.count() == 1
    assert 0 < scanned(one) <= hold[0]
    # a key within the bounds that isn't there: the Bloom filter leaves nothing to read
    assert scanned(table.where(F.col("key") == 31417)) == 0


def test_details_of_one_key_push_the_key_into_every_mart(spark):
    from conftest import SF_SMALL
    from townrisk.plans import serve as S
    one = S.detail(spark, SF_SMALL, key=7)
    text = one._jdf.queryExecution().executedPlan().toString()
    assert text.count("EqualTo(key,7)") == 4
    assert "Python" not in text
    whole = {r["key"]: r for r in S.detail(spark, SF_SMALL).collect()}
    assert one.collect() == [whole[7]]
