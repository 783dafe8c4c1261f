"""Distributed shapefile ingest (polygon and point layers with attributes).

Plan: the small ``.shx`` index of every file is read with the ``binaryFile``
source; a first Arrow function turns it into record ranges of at most
``records_per_task`` records (with the byte offset of each record); the
ranges are spread over tasks; a second Arrow function reads exactly those
byte ranges of ``.shp`` and ``.dbf`` (positional reads through
``pyarrow.fs``, so local disks and object stores work alike) and emits one
row per feature.  No file is ever read whole by one task or the driver.

Rings are returned in the engine's convention: outer rings counter-
clockwise, holes clockwise, no repeated closing vertex (shapefiles store
outer rings clockwise and closed).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_SCHEMA = "shp string, first long, offsets array<long>"
FEATURE_SCHEMA = ("file string, rec long, shape_type int, x double, y double, "
                  "rings array<array<struct<x: double, y: double>>>, attrs map<string, string>")


def _fs_path(uri: str):
    import pyarrow.fs as pafs
    if uri.startswith("file:"):
        uri = uri[5:]
        while uri.startswith("//"):
            uri = uri[1:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _ranges(records_per_task: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                body = bytes(content)[100:]
                n = len(body) // 8
                offs = [struct.unpack(">i", body[8 * i:8 * i + 4])[0] * 2 for i in range(n)]
                shp = path[:-4] + ".shp"
                for s in range(0, n, records_per_task):
                    out.append((shp, s, offs[s:s + records_per_task]))
            yield pd.DataFrame(out, columns=["shp", "first", "offsets"])
    return run


def _dbf_header(f) -> tuple[int, int, int, list[tuple[str, int]]]:
    head = f.read_at(32, 0)
    n, hlen, rlen = struct.unpack("<IHH", head[4:12])
    desc = f.read_at(hlen - 32, 32)
    fields = []
    for i in range(0, len(desc) - 1, 32):
        d = desc[i:i + 32]
        if d[0] == 0x0D:
            break
        fields.append((d[:11].split(b"\x00")[0].decode("ascii", "replace"), d[16]))
    return n, hlen, rlen, fields


def _decode(encoding: str):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for shp, first, offsets in zip(pdf["shp"], pdf["first"], pdf["offsets"]):
                fs, p = _fs_path(shp)
                dbf_p = p[:-4] + ".dbf"
                try:
                    dbf = fs.open_input_file(dbf_p)
                    n_dbf, hlen, rlen, fields = _dbf_header(dbf)
                except (FileNotFoundError, OSError):
                    dbf, fields = None, []
                with fs.open_input_file(p) as f:
                    for k, off in enumerate(offsets):
                        rec = int(first) + k
                        hdr = f.read_at(8, off)
                        clen = struct.unpack(">i", hdr[4:8])[0] * 2
                        body = f.read_at(clen, off + 8)
                        stype = struct.unpack("<i", body[:4])[0]
                        x = y = None
                        rings = None
                        if stype in (1, 11, 21):                       # point (z/m variants)
                            x, y = struct.unpack("<2d", body[4:20])
                        elif stype in (5, 15, 25):                     # polygon (z/m variants)
                            nparts, npts = struct.unpack("<2i", body[36:44])
                            parts = list(struct.unpack(f"<{nparts}i", body[44:44 + 4 * nparts]))
                            base = 44 + 4 * nparts
                            pts = struct.unpack(f"<{2 * npts}d", body[base:base + 16 * npts])
                            rings = []
                            for j, s in enumerate(parts):
                                e = parts[j + 1] if j + 1 < nparts else npts
                                ring = [{"x": pts[2 * i], "y": pts[2 * i + 1]} for i in range(s, e)]
                                if len(ring) > 1 and ring[0] == ring[-1]:
                                    ring = ring[:-1]
                                rings.append(ring[::-1])                # clockwise -> ccw
                        attrs = None
                        if dbf is not None and rec < n_dbf:
                            raw = dbf.read_at(rlen, hlen + rec * rlen)
                            pos, attrs = 1, {}
                            for name, width in fields:
                                attrs[name] = raw[pos:pos + width].decode(encoding, "replace").strip()
                                pos += width
                        rows.append((shp, rec, stype, x, y, rings, attrs))
                if dbf is not None:
                    dbf.close()
            yield pd.DataFrame(rows, columns=["file", "rec", "shape_type", "x", "y", "rings", "attrs"])
    return run


def load_shapefiles(spark: SparkSession, pattern: str, encoding: str = "cp932",
                    records_per_task: int = 2000, tasks: int | None = None) -> DataFrame:
    """Features of every shapefile matching ``pattern`` (a ``*.shp`` glob).

    Empty files contribute no rows.  The result has one row per record:
    file, rec, shape_type, x/y (points), rings (polygons), attrs.
    """
    shx = pattern[:-4] + ".shx" if pattern.endswith(".shp") else pattern
    idx = spark.read.format("binaryFile").load(shx).select("path", "content")
    ranges = idx.mapInPandas(_ranges(records_per_task), RANGE_SCHEMA)
    n = tasks or max(1, spark.sparkContext.defaultParallelism)
    ranges = ranges.repartition(n)
    return ranges.mapInPandas(_decode(encoding), FEATURE_SCHEMA)


def polygons_in_codes(df: DataFrame, code_field: str, codes, name_field: str) -> DataFrame:
    """Keep polygons whose code attribute is in ``codes`` and whose name
    attribute is present (the area-polygon filter of the boundary data)."""
    code, name = F.col("attrs")[code_field], F.col("attrs")[name_field]
    return df.where(code.isin(*codes) & name.isNotNull() & (name != ""))


def ingest_shapefiles(spark: SparkSession, pattern: str, out_path: str, rebuild: bool = False,
                      encoding: str = "cp932", to_plane: bool = False) -> DataFrame:
    """Staged ingest: decode once, optionally project rings to metres, keep
    the bounding box as plain columns (Parquet min/max statistics then
    prune row groups for box predicates), write Parquet, reuse on later
    runs unless ``rebuild``."""
    from ..functions import geo as G
    from .staging import materialize

    def build() -> DataFrame:
        df = load_shapefiles(spark, pattern, encoding=encoding)
        df = df.withColumn("rings", G.col(G.clean_signed_rings_sql("rings"))) \
               .withColumn("valid", G.rings_valid("rings"))
        if to_plane:
            df = df.withColumn("rings", G.rings_to_plane("rings"))
        xmin, ymin, xmax, ymax = G.bbox("rings")
        return (df.withColumn("xmin", xmin).withColumn("ymin", ymin)
                  .withColumn("xmax", xmax).withColumn("ymax", ymax)
                  .sortWithinPartitions("xmin", "ymin"))
    return materialize(spark, build, out_path, rebuild=rebuild)
