"""Readers for the engine's raw inputs and writers for its outputs.

Every reader is a plain ``spark.read`` (splittable, column-pruned, one
task per split); nothing is read through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo as G
from ..functions import text as X
from .geojson_split import SPLIT, split_features


# --- guards ---------------------------------------------------------------------

def require_path(spark: SparkSession, path: str, what: str) -> str:
    """Fail loudly when a required input is missing."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    found = fs.globStatus(p)
    if found is None or len(found) == 0:
        raise FileNotFoundError(f"required input missing: {what} ({path})")
    return path


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """An empty input must never pass as 'no risk'."""
    if df.isEmpty():
        raise ValueError(f"input has no rows: {what}")
    return df


def optional_input(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing optional input is an empty frame with the given schema."""
    try:
        require_path(spark, path, path)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


# --- CSV sources ------------------------------------------------------------------

def load_crime(spark: SparkSession, path: str, count_cols, wards=K.WARDS,
               name_col: str = "市区町丁", encoding: str = "windows-31j") -> DataFrame:
    """Crime counts per area (Shift_JIS CSV): ward split, non-area rows
    removed, composite key, counts as long (missing -> 0)."""
    from ..plans.names import split_names
    d = (spark.read.option("header", True).option("encoding", encoding)
         .csv(require_path(spark, path, "crime counts")))
    d = split_names(d.withColumn(name_col, F.trim(F.col(name_col))), name_col, wards)
    cols = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in count_cols]
    require_rows(d, f"crime counts ({path})")
    return d.select(F.col("name_key").alias("key"), "ward", "town", *cols)


POP_CODE, POP_WARD, POP_LEVEL, POP_TOWN = "地域コード", "地域", "町丁別地域階層", "町丁別地域"
POP_TOTAL, POP_HOUSEHOLDS = "人口／総数(人)", "世帯数(世帯)"


def load_population(spark: SparkSession, path: str) -> DataFrame:
    """Population per area (UTF-8 CSV with BOM): the 23 ward codes, area
    level rows only; key = ward | normalised town; display town trimmed."""
    p = spark.read.option("header", True).csv(require_path(spark, path, "population"))
    codes = [f"131{i:02d}" for i in range(1, 24)]
    p = p.where(F.col(POP_CODE).isin(*codes) & (F.col(POP_LEVEL).cast("int") == 1))
    require_rows(p, f"population ({path})")
    return p.select(
        F.concat_ws(K.KEY_SEPARATOR, F.col(POP_WARD), X.norm_name_nfkc(F.col(POP_TOWN))).alias("key"),
        F.col(POP_WARD).alias("ward"), X.display_name(F.col(POP_TOWN)).alias("town"),
        F.col(POP_TOTAL).cast("long").alias("pop"),
        F.col(POP_HOUSEHOLDS).cast("long").alias("households"))


def number(name: str) -> "F.Column":
    """A numeric column in which NaN, like an empty cell, is no value."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


PT_DEPTH, PT_ELEV, PT_LAT, PT_LON = "浸水深", "地盤高", "緯度", "経度"


def basin_from_file(file_name) -> "F.Column":
    """Basin label from a 'shinsui_<slug>.csv' file name; an unknown slug
    stands for itself."""
    slug = F.regexp_extract(file_name, K.BASIN_FILE_PATTERN, 1)
    m = F.create_map(*[F.lit(x) for kv in K.BASIN_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(m, slug), slug)


def load_flood_points(spark: SparkSession, folder: str) -> DataFrame:
    """All depth grid files of a folder in ONE scan (files split into
    tasks; only the four used columns are parsed): x, y, depth, elev, basin."""
    pattern = os.path.join(folder, "shinsui_*.csv")
    require_path(spark, pattern, "flood depth grid files")
    d = require_rows(spark.read.option("header", True).csv(pattern), f"flood depth grid ({folder})")
    return d.select(number(PT_LON).alias("x"), number(PT_LAT).alias("y"),
                    number(PT_DEPTH).alias("depth"), number(PT_ELEV).alias("elev"),
                    basin_from_file(F.col("_metadata.file_name")).alias("basin"))


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """An exported table CSV with every column read as text."""
    return spark.read.option("header", True).csv(require_path(spark, path, "table csv"))


# --- rules of the real inputs -------------------------------------------------------

def _lookup(table: dict, key: "F.Column") -> "F.Column":
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def resolve_polygons(areas: DataFrame, polygons: DataFrame, alias: dict[str, str] = K.POLYGON_ALIAS) -> DataFrame:
    """``areas`` (key, ...) with the polygon columns of ``polygons`` (poly_key,
    ...): through the alias table, else by the area's own key; ``poly_key``
    stays, ``has_polygon`` says whether the boundary data knows it."""
    named = areas.withColumn("poly_key", F.coalesce(_lookup(alias, F.col("key")), F.col("key")))
    known = polygons.withColumn("has_polygon", F.lit(True))
    return named.join(known, "poly_key", "left").withColumn("has_polygon", F.coalesce("has_polygon", F.lit(False)))


def in_tide_scope(ward: "F.Column") -> "F.Column":
    """Whether the tide hazard map covers a ward."""
    return ~ward.isin(*K.TIDE_OUT_OF_SCOPE)


def boring_weights(borings: DataFrame, label: str) -> DataFrame:
    """``borings`` with ``w``, the weight of their class label; an unknown label stops the build."""
    from ..plans.zones import assert_known_codes
    weights = {K.PL_CLASS_SMALL: K.PL_WEIGHT_SMALL, K.PL_CLASS_MID: K.PL_WEIGHT_MID, K.PL_CLASS_LARGE: K.PL_WEIGHT_LARGE}
    codes = borings.sparkSession.createDataFrame([(k,) for k in weights], "cls string")
    assert_known_codes(borings.select(F.col(label).alias("cls")), codes)
    return borings.withColumn("w", _lookup(weights, F.col(label)))


# --- GeoJSON ------------------------------------------------------------------------

FEATURE_SCHEMA = ("struct<type: string, properties: map<string, string>, "
                  "geometry: struct<type: string, coordinates: string>>")
FEATURES_SCHEMA = f"features array<{FEATURE_SCHEMA}>"


def load_geojson(spark: SparkSession, paths) -> DataFrame:
    """Feature collections from many files -> (file, fid, properties, rings).

    Coordinates are kept as JSON text by the reader and parsed per geometry
    type, so Polygon and MultiPolygon features share one scan.  Files with
    no features contribute no rows; no file at all is an error.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise FileNotFoundError("no GeoJSON files given")
    for p in paths:
        require_path(spark, p, "GeoJSON")
    d = spark.read.option("multiLine", True).schema(FEATURES_SCHEMA).json(paths)
    f = d.select(F.col("_metadata.file_name").alias("file"),
                 F.posexplode("features").alias("fid", "f"))
    return _polygon_features(f.select("file", F.col("fid").cast("long").alias("fid"), "f"))


def load_geojson_split(spark: SparkSession, paths, split: int = SPLIT) -> DataFrame:
    """The same rows as :func:`load_geojson`, but every file is read in byte ranges by many tasks."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise FileNotFoundError("no GeoJSON files given")
    for p in paths:
        require_path(spark, p, "GeoJSON")
    f = split_features(spark, paths, split)
    return _polygon_features(f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("fid").cast("long").alias("fid"),
                                      F.from_json("text", FEATURE_SCHEMA).alias("f")))


def _polygon_features(f: DataFrame) -> DataFrame:
    gtype, coords = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    poly = F.array(F.from_json(coords, "array<array<array<double>>>"))
    multi = F.from_json(coords, "array<array<array<array<double>>>>")
    raw = F.when(gtype == "Polygon", poly).when(gtype == "MultiPolygon", multi)
    rings = F.transform(raw, lambda part: F.transform(part, lambda r: F.transform(
        r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    out = f.select("file", "fid",
                   F.col("f.properties").alias("properties"), rings.alias("raw")) \
        .where(F.col("raw").isNotNull())
    # ring hygiene per part: open rings, no repeated vertices, outer ccw / holes cw
    out = out.withColumn("rings", G.col(G.clean_parts_sql("raw"))).drop("raw")
    return out.withColumn("valid", G.rings_valid("rings"))


# --- sinks -----------------------------------------------------------------------------

def write_marts(marts: dict[str, DataFrame], out_dir: str) -> None:
    """Idempotent reload: each mart is overwritten partition by partition
    (dynamic partition overwrite on ``data_year`` when present)."""
    for name, df in marts.items():
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if "data_year" in df.columns:
            w = w.partitionBy("data_year")
        w.parquet(os.path.join(out_dir, name))


def write_geojson_by_ward(features: DataFrame, out_dir: str) -> None:
    """One folder of feature lines per ward code."""
    features.select("ward_code", "feature").write.mode("overwrite") \
        .partitionBy("ward_code").text(out_dir)


def register_served(spark: SparkSession, out_dir: str, names=("towns", "town_scores",
                                                               "crime_counts", "hazard_details")):
    """Temp views over the written marts for SQL serving queries."""
    for n in names:
        spark.read.parquet(os.path.join(out_dir, n)).createOrReplaceTempView(n)


def served_index(spark: SparkSession, out_dir: str, year: int) -> DataFrame:
    """The index list over written marts: scores and coverage of one year beside each area."""
    def mart(name: str) -> DataFrame:
        return spark.read.parquet(os.path.join(out_dir, name))

    scores = mart("town_scores").where(F.col("data_year") == year).select(
        "key", "safety_score", "flood_score", "tide_score", "ground_score", "scored")
    covered = mart("hazard_details").where(F.col("data_year") == year).select(
        "key", "flood_covered", "tide_in_scope", "liq_covered")
    areas = mart("towns").select("key", "ward", "town", "population", "lat", "lng")
    return areas.join(scores, "key").join(covered, "key").orderBy("ward", "town")


def with_bbox(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Bounding-box columns of a polygon column (stored with staged geometry
    so box predicates prune Parquet row groups)."""
    xmin, ymin, xmax, ymax = G.bbox(rings)
    return df.withColumn("xmin", xmin).withColumn("ymin", ymin) \
             .withColumn("xmax", xmax).withColumn("ymax", ymax)


def bbox_filter(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Keep features whose box meets ``(xmin, ymin, xmax, ymax)``."""
    x0, y0, x1, y1 = box
    if "xmin" not in df.columns:
        df = with_bbox(df)
    return df.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0)
                    & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
