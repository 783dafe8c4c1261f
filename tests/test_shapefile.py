from pyspark.sql import functions as F

from shp_writer import write_points, write_polygons
from townrisk.functions import geo as G
from townrisk.sources.shapefile import load_shapefiles, polygons_in_codes


def test_polygon_layer_with_hole_and_attrs(spark, tmp_path):
    outer_cw = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]       # shapefile: outer clockwise
    hole_ccw = [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
    tri_cw = [(20, 0), (23, 6), (26, 0), (20, 0)]
    write_polygons(str(tmp_path / "towns"), [[outer_cw, hole_ccw], [tri_cw], [tri_cw]],
                   [("CITY", 3), ("S_NAME", 12)], [("101", "丸の内"), ("101", ""), ("999", "他")])
    df = load_shapefiles(spark, str(tmp_path / "*.shp"), records_per_task=1)
    rows = {r.rec: r for r in df.select("rec", "attrs", G.area("rings").alias("a"),
                                        G.col(G.signed_area_sql("rings")).alias("sa")).collect()}
    assert rows[0].a == 96.0 and rows[0].sa == 96.0             # ccw outer, cw hole
    assert rows[1].a == 18.0
    assert rows[0].attrs == {"CITY": "101", "S_NAME": "丸の内"}
    kept = polygons_in_codes(df, "CITY", ["101"], "S_NAME").select("rec").collect()
    assert [r.rec for r in kept] == [0]


def test_point_layer_and_empty_file(spark, tmp_path):
    write_points(str(tmp_path / "liq"), [(1.5, 2.5), (3.0, 4.0)], [("PL", 12)], [("小",), ("大",)])
    write_points(str(tmp_path / "empty"), [], [("PL", 12)], [])
    df = load_shapefiles(spark, str(tmp_path / "*.shp"))
    got = sorted((r.x, r.y, r.attrs["PL"]) for r in df.collect())
    assert got == [(1.5, 2.5, "小"), (3.0, 4.0, "大")]
    assert df.where(F.col("file").endswith("/empty.shp")).count() == 0
    assert df.count() == 2


def test_ingest_staged_and_projected(spark, tmp_path):
    from townrisk.sources.shapefile import ingest_shapefiles
    sq = [(139.76, 35.67), (139.76, 35.68), (139.77, 35.68), (139.77, 35.67), (139.76, 35.67)]
    write_polygons(str(tmp_path / "geo"), [[sq]], [("CITY", 3)], [("101",)])
    out = str(tmp_path / "staged")
    df = ingest_shapefiles(spark, str(tmp_path / "geo.shp"), out, to_plane=True)
    r = df.select(G.area("rings").alias("a"), "xmin", "ymax").collect()[0]
    # 0.01 deg x 0.01 deg near 35.7N is about 903 m x 1109 m
    assert 0.95e6 < r.a < 1.05e6
    again = ingest_shapefiles(spark, str(tmp_path / "missing.shp"), out)   # reused, not rebuilt
    assert again.count() == 1
