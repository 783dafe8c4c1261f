"""The streaming twin is incremental and equals the batch aggregate."""

import shutil

from pyspark.sql import functions as F

from conftest import SF_SMALL
from townrisk.plans import zones as Z
from townrisk.streaming.zone_stream import zone_stats_stream


def _batch(spark):
    st = Z.zone_stats(Z.zone_basin_stats(Z.points_in_zones(spark, SF_SMALL)))
    return {r.zone: (r.n, r.n_flood, round(r.depth_sum, 6), r.elev_min) for r in st.collect()}


def _stream(df):
    return {r.zone: (r.n, r.n_flood, round(r.depth_sum, 6), r.elev_min) for r in df.collect()}


def test_stream_is_incremental_and_equals_batch(spark, tmp_path):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    src = tmp_path / "src"
    part_a = li.where(F.col("l_orderkey") % 2 == 0)
    part_b = li.where(F.col("l_orderkey") % 2 == 1)
    part_a.coalesce(1).write.parquet(str(tmp_path / "a"))
    part_b.coalesce(1).write.parquet(str(tmp_path / "b"))
    src.mkdir()
    fa = next((tmp_path / "a").glob("part-*.parquet"))
    fb = next((tmp_path / "b").glob("part-*.parquet"))
    shutil.copy(fa, src / "lineitem-a.parquet")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    first = _stream(zone_stats_stream(spark, SF_SMALL, out_dir=out, checkpoint=ckpt,
                                      source_dir=str(src)))
    shutil.copy(fb, src / "lineitem-b.parquet")    # a new file arrives
    second = _stream(zone_stats_stream(spark, SF_SMALL, out_dir=out, checkpoint=ckpt,
                                       source_dir=str(src)))
    full = _batch(spark)
    assert sum(v[0] for v in first.values()) < sum(v[0] for v in full.values())
    assert second == full


def test_only_changed_zones_are_written(spark, tmp_path):
    from townrisk.streaming.versions import VersionedTable
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    src, out, ckpt = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()
    # the second file holds points of one zone only
    inside = {(r.x, r.y) for r in Z.points_in_zones(spark, SF_SMALL).where("zone = 7").collect()}
    rows = [r for r in li.collect() if ((r.l_orderkey * 7919 + r.l_linenumber * 104729) % 99991 / 1000.0,
                                        (r.l_orderkey * 15485863 + r.l_linenumber * 32452843) % 99989 / 1000.0) in inside]
    assert rows
    spark.createDataFrame(rows, li.schema).coalesce(1).write.parquet(str(tmp_path / "b"))
    shutil.copy(f"{SF_SMALL}/lineitem.parquet", src / "lineitem-a.parquet")
    zone_stats_stream(spark, SF_SMALL, out_dir=out, checkpoint=ckpt, source_dir=str(src))
    before = _stream(VersionedTable(spark, out, ["zone"]).read())
    shutil.copy(next((tmp_path / "b").glob("part-*.parquet")), src / "lineitem-b.parquet")
    after = _stream(zone_stats_stream(spark, SF_SMALL, out_dir=out, checkpoint=ckpt, source_dir=str(src)))
    assert {z for z in after if after[z] != before.get(z)} == {7}
    done = VersionedTable(spark, out, ["zone"]).build.finished()
    last = done[max((c for c in done if c.startswith("epoch")), key=lambda c: int(c.split()[1]))]
    assert [r.zone for r in spark.read.parquet(last).collect()] == [7]


def test_a_replayed_epoch_changes_nothing(spark, tmp_path):
    from townrisk.streaming.versions import VersionedTable
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert t.upsert(rows((1, "a"), (2, "b")), 0) and t.upsert(rows((2, "c"), (3, None)), 1)
    want = {(1, "a"), (2, "c"), (3, None)}
    assert {tuple(r) for r in t.read().collect()} == want
    assert not t.upsert(rows((1, "other")), 0) and not VersionedTable(spark, str(tmp_path / "t"), ["k"]).upsert(rows((9, "x")), 1)
    assert {tuple(r) for r in t.read().collect()} == want


def test_epochs_are_folded(spark, tmp_path, monkeypatch):
    from townrisk.streaming import versions as V
    monkeypatch.setattr(V, "FOLD", 3)
    t = V.VersionedTable(spark, str(tmp_path / "t"), ["k"])
    for e in range(8):
        t.upsert(spark.createDataFrame([(e % 2, e)], "k long, v long"), e)
        assert len(t._parts()[0]) <= 4
        assert {tuple(r) for r in t.read().collect()} == {(x % 2, x) for x in range(max(0, e - 1), e + 1)}
    assert any(c.startswith("base") for c in t.build.finished())
