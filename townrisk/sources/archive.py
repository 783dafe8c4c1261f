"""Members of a ZIP archive as Spark input.

Only the archive's central directory (names and sizes) is read on the
driver.  Each selected member is then copied out by its own task through a
seekable ``pyarrow.fs`` handle (local disks and object stores alike) into a
staging folder, from where the regular readers take over.  Member names
written with back-slashes are normalised to forward slashes.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .shapefile import _fs_path


def _open(uri: str):
    fs, p = _fs_path(uri)
    return fs, p


def list_members(zip_uri: str, prefix: str = "", contains: str = "") -> list[str]:
    """Member names (normalised) under ``prefix`` that contain ``contains``."""
    fs, p = _open(zip_uri)
    with fs.open_input_file(p) as f, zipfile.ZipFile(f) as z:
        out = []
        for info in z.infolist():
            name = info.filename.replace("\\", "/")
            if not info.is_dir() and name.startswith(prefix) and contains in name:
                out.append(name)
    return sorted(out)


def _extract(zip_uri: str, out_dir: str):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, p = _open(zip_uri)
        ofs, op = _open(out_dir)
        rows = []
        with fs.open_input_file(p) as f, zipfile.ZipFile(f) as z:
            by_norm = {i.filename.replace("\\", "/"): i for i in z.infolist()}
            for pdf in it:
                for name in pdf["member"]:
                    target = os.path.join(op, name)
                    ofs.create_dir(os.path.dirname(target), recursive=True)
                    size = 0
                    with z.open(by_norm[name]) as src, ofs.open_output_stream(target) as dst:
                        while True:
                            chunk = src.read(1 << 20)
                            if not chunk:
                                break
                            dst.write(chunk)
                            size += len(chunk)
                    rows.append((name, target, size))
        yield pd.DataFrame(rows, columns=["member", "path", "bytes"])
    return run


def extract_members(spark: SparkSession, zip_uri: str, members: list[str], out_dir: str) -> DataFrame:
    """Copy the given members out, one member per task: (member, path, bytes)."""
    if not members:
        raise FileNotFoundError(f"no matching members in {zip_uri}")
    df = spark.createDataFrame([(m,) for m in members], "member string")
    df = df.repartition(len(members))
    return df.mapInPandas(_extract(zip_uri, out_dir), "member string, path string, bytes long")
