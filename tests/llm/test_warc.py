"""WARC: every record is owned by one range, whatever the split; round trip of odd pages."""

import hashlib
import io
import random

import pytest
from townrisk.llm import warc as W


def test_any_split_owns_each_record_once():
    rng = random.Random(1)
    # noise with magic bytes in front and between, as a reader meets them
    parts, places, at = [], [], 0
    for k in range(60):
        junk = rng.choice((b"", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00junk" * 3, bytes(rng.randrange(256) for _ in range(50))))
        member = W.record("response", k, "u", bytes(rng.randrange(256) for _ in range(rng.randrange(3000))), "x")
        parts += [junk, member]
        places.append(at + len(junk))
        at += len(junk) + len(member)
    data = b"".join(parts)
    for split in (17, 1000, 4096, len(data)):
        found = [p for lo in range(0, len(data), split)
                 for p, _ in W.members(W.Window(io.BytesIO(data), len(data)), lo, min(len(data), lo + split))]
        assert found == places


def test_magic_over_a_block_end(monkeypatch):
    monkeypatch.setattr(W, "READ", 64)
    data = b"x" * 62 + W.record("response", 1, "u", b"abc" * 100, "d") + b"\x1f"
    assert [p for p, _ in W.members(W.Window(io.BytesIO(data), len(data)), 0, len(data))] == [62]
    assert W.inflate(W.Window(io.BytesIO(data[:80]), 80), 62) is None  # a cut record isn't whole


def plain(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            first[b] = max(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        r = first.get(b) if first.get(b) != p else None
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if r is not None else "response", r))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 500
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (7, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "s" * 999),
            (6, "u", "s" * 999), (8, "u", "t" * 1000), (9, "u", "t" * 1000), (10, "u", "WARC/1.1\r\n\r\n" + "q" * 200_000),
            (None, "u", "n"), (11, "u", "v" * 2000), (11, "u", "v" * 2000), (None, "u", "t" * 1000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, sha1 int, refers_to string")
    got = W.round_trip(df, str(tmp_path / "w"), roll=900, split=700).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = W.round_trip(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain([(r.page_id, r.url, r.html) for r in df.collect()])
    assert W.round_trip(df.limit(0)).collect() == []


def test_long_headers(spark, tmp_path):
    rng = random.Random(2)
    url = "data:" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(3 << 20))
    data = W.record("response", 1, url, b"first", "d") + W.record("response", 2, "u", b"second", "d")
    found = [W.parse(c) for _, c in W.members(W.Window(io.BytesIO(data), len(data)), 0, len(data))]
    assert [(h["warc-target-uri"], p) for h, p in found] == [(url, b"first"), ("u", b"second")]
    df = spark.createDataFrame([(1, url, "a"), (2, "u", "b")], "page_id long, url string, html string")
    assert {r.page_id: r.payload_bytes for r in W.round_trip(df, str(tmp_path / "w"), split=100_000).collect()} == {1: 1, 2: 1}


def test_lost_records_stop(spark):
    archives = spark.createDataFrame([("a", 9, 2), ("b", 9, 1), ("c", 9, 1)], "path string, bytes long, records long")
    W.check_counts(archives, spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "path string"))
    with pytest.raises(ValueError, match="a 2 1; c 1 0|c 1 0; a 2 1"):
        W.check_counts(archives, spark.createDataFrame([("a",), ("b",)], "path string"))


def test_repeated_page_ids_with_other_payloads(spark, tmp_path):
    x, y = "x" * 1500, "y" * 1500
    rows = [(5, "a", x), (5, "b", y), (1, "c", x), (2, "d", y), (2, "e", "short"), (5, "f", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as named", "2 as path")
    got = [tuple(r) for r in W.round_trip(pages, str(tmp_path / "w")).collect()]
    assert sorted(got, key=str) == plain(rows) and len(got) == len(rows)


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(600).selectExpr("id as page_id", "'u' as url", "sha2(string(id), 512) || repeat(sha2(string(id + 7), 512), 20) as html")
    archives = W.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    assert archives.count() == 1
    from pyspark.sql import functions as F
    read = W.read_archives(archives, 4096)
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 10 and read.count() == 600
