import json
import os

import pytest

from townrisk.functions import geo as G
from townrisk.sources import files as S


def test_load_flood_points_basin(spark, tmp_path):
    head = "図郭No,浸水深,地盤高,緯度,経度\n"
    (tmp_path / "shinsui_kandagawa.csv").write_text("﻿" + head + "a,0.5,3.0,35.7,139.7\nb,0,2.0,35.71,139.71\n", encoding="utf-8")
    (tmp_path / "shinsui_unknown.csv").write_text("﻿" + head + "c,1.25,-1.0,35.6,139.8\n", encoding="utf-8")
    d = S.load_flood_points(spark, str(tmp_path))
    got = sorted((r.basin, r.depth) for r in d.collect())
    assert got == [("unknown", 1.25), ("神田川流域", 0.0), ("神田川流域", 0.5)]


def test_missing_inputs_fail(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.load_flood_points(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        S.require_rows(spark.createDataFrame([], "a int"), "empty")
    e = S.optional_input(spark, str(tmp_path / "missing.parquet"), "key string")
    assert e.count() == 0


def test_load_crime_shift_jis(spark, tmp_path):
    text = ("市区町丁,凶悪犯強盗,総合計\n千代田区計,9,9\n千代田区丸の内１丁目,1,3\n"
            "千代田区,5,5\n港区以下不詳,1,1\n港区麻布十番二丁目 ,,2\n")
    p = tmp_path / "crime.csv"
    p.write_bytes(text.encode("cp932"))
    d = S.load_crime(spark, str(p), ["凶悪犯強盗", "総合計"])
    got = sorted((r.key, r["凶悪犯強盗"], r["総合計"]) for r in d.collect())
    assert got == [("千代田区|丸の内1丁目", 1, 3), ("港区|麻布十番2丁目", 0, 2)]


def test_load_population(spark, tmp_path):
    text = ("地域コード,地域,町丁別地域階層,町丁別地域,人口／総数(人),世帯数(世帯)\n"
            "13101,千代田区,0,千代田区,60000,30000\n13101,千代田区,1,　丸の内１丁目,12,10\n"
            "13201,八王子市,1,元本郷町一丁目,100,50\n")
    p = tmp_path / "pop.csv"
    p.write_text("﻿" + text, encoding="utf-8")
    got = [tuple(r) for r in S.load_population(spark, str(p)).collect()]
    assert got == [("千代田区|丸の内1丁目", "千代田区", "丸の内１丁目", 12, 10)]


def test_load_geojson(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"A31a_205": "3"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"A31a_205": "1"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 0]]],
                                                              [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(fc))
    (tmp_path / "empty.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    d = S.load_geojson(spark, [str(tmp_path / "a.geojson"), str(tmp_path / "empty.geojson")])
    rows = sorted(d.collect(), key=lambda r: r.fid)
    assert [len(r.rings) for r in rows] == [1, 2]
    assert [len(r.rings[0]) for r in rows] == [3, 3]
    areas = [r.a for r in d.orderBy("fid").select(G.area("rings").alias("a")).collect()]
    assert areas == [0.5, 2.5]  # both parts of the second feature count
    assert rows[0].properties["A31a_205"] == "3"
    with pytest.raises(FileNotFoundError):
        S.load_geojson(spark, [])


def test_write_and_serve(spark, tmp_path):
    t = spark.createDataFrame([(1, "w", "a", 10.0, 35.0, 139.0)], "key long, ward string, town string, population double, lat double, lng double")
    s = spark.createDataFrame([(1, 2025, 50.0, 60.0, 70.0, 80.0, 1)], "key long, data_year int, safety_score double, flood_score double, tide_score double, ground_score double, scored int")
    h = spark.createDataFrame([(1, 2025, 1, 0, 1)], "key long, data_year int, flood_covered int, tide_in_scope int, liq_covered int")
    out = str(tmp_path / "marts")
    S.write_marts({"towns": t, "town_scores": s, "hazard_details": h}, out)
    S.write_marts({"town_scores": s}, out)        # idempotent reload
    S.register_served(spark, out, names=("towns", "town_scores", "hazard_details"))
    r = S.served_index(spark, out, 2025).collect()
    assert len(r) == 1 and r[0].tide_score == 70.0
    assert os.path.isdir(os.path.join(out, "town_scores", "data_year=2025"))


def test_geojson_by_ward(spark, tmp_path):
    from townrisk.plans.serve_queries import geojson_features
    from conftest import SF_SMALL
    out = str(tmp_path / "gj")
    S.write_geojson_by_ward(geojson_features(spark, SF_SMALL), out)
    wards = sorted(p.name for p in (tmp_path / "gj").iterdir() if p.name.startswith("ward_code="))
    assert len(wards) == 5
    back = spark.read.text(out)
    assert back.count() == 24                                  # one area has no polygon
    first = json.loads(back.first().value)
    assert first["type"] == "Feature" and first["geometry"]["type"] == "Polygon"


def test_zip_members(spark, tmp_path):
    import zipfile
    from townrisk.sources.archive import extract_members, list_members
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"A31a_205": "2"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [3, 0], [3, 3], [0, 0]]]}}]}
    zp = tmp_path / "rivers.zip"
    with zipfile.ZipFile(zp, "w") as z:
        z.writestr("20_x\\8303040001\\a.geojson", json.dumps(fc))     # back-slash member name
        z.writestr("20_x\\8303030284\\b.geojson", json.dumps(fc))
        z.writestr("41_other/c.geojson", json.dumps(fc))
    names = list_members(str(zp), prefix="20_", contains="8303040001")
    assert names == ["20_x/8303040001/a.geojson"]
    out = str(tmp_path / "unzipped")
    got = extract_members(spark, str(zp), list_members(str(zp), prefix="20_"), out).collect()
    assert sorted(r.member for r in got) == ["20_x/8303030284/b.geojson", "20_x/8303040001/a.geojson"]
    feats = S.load_geojson(spark, [r.path for r in got])
    assert feats.count() == 2
    assert S.bbox_filter(feats, (2.5, 2.5, 9.0, 9.0)).count() == 2
    assert S.bbox_filter(feats, (5.0, 5.0, 9.0, 9.0)).count() == 0
    with pytest.raises(FileNotFoundError):
        extract_members(spark, str(zp), list_members(str(zp), prefix="99_"), out)


def test_overview_features(spark, tmp_path):
    from conftest import SF_SMALL
    from townrisk.plans.geo_queries import overview_features
    rows = overview_features(spark, SF_SMALL).collect()
    assert len(rows) == 5
    f = json.loads(rows[0].feature)
    ring = f["geometry"]["coordinates"][0]
    assert f["type"] == "Feature" and len(ring) == 5          # collinear corners simplified away, closed


def test_rules_of_the_real_inputs(spark):
    from pyspark.sql import functions as F
    from townrisk import constants as K
    areas = spark.createDataFrame([("大田区|令和島1丁目",), ("大田区|令和島2丁目",), ("港区|芝1丁目",), ("港区|海",)], "key string")
    polys = spark.createDataFrame([("大田区|令和島", 5.0), ("港区|芝1丁目", 7.0)], "poly_key string, area double")
    got = {r.key: (r.poly_key, r.has_polygon, r.area) for r in S.resolve_polygons(areas, polys).collect()}
    assert got["大田区|令和島1丁目"] == got["大田区|令和島2丁目"] == ("大田区|令和島", True, 5.0)
    assert got["港区|芝1丁目"][1] and got["港区|海"] == ("港区|海", False, None)
    scope = spark.createDataFrame([("練馬区",), ("港区",)], "ward string").select("ward", S.in_tide_scope(F.col("ward")).alias("s"))
    assert {r.ward: r.s for r in scope.collect()} == {"練馬区": False, "港区": True}
    b = spark.createDataFrame([(K.PL_CLASS_SMALL,), (K.PL_CLASS_LARGE,), (None,)], "c string")
    assert sorted(r.w for r in S.boring_weights(b, "c").collect() if r.w is not None) == sorted([K.PL_WEIGHT_SMALL, K.PL_WEIGHT_LARGE])
    with pytest.raises(ValueError):
        S.boring_weights(b.union(spark.createDataFrame([("?",)], "c string")), "c")


def test_empty_input_stops(spark, tmp_path):
    (tmp_path / "shinsui_kanda.csv").write_text("緯度,経度,浸水深,地盤高\n", encoding="utf-8")
    with pytest.raises(ValueError):
        S.load_flood_points(spark, str(tmp_path))
    (tmp_path / "shinsui_kanda.csv").write_text("緯度,経度,浸水深,地盤高\n35.0,139.0,NaN,1.5\n", encoding="utf-8")
    r = S.load_flood_points(spark, str(tmp_path)).first()
    assert r.depth is None and r.elev == 1.5 and r.x == 139.0
