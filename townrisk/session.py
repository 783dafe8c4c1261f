"""SparkSession construction and session-level helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on. They are applied only when the caller has not
# set them already, so a cluster's own configuration always wins.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Shift_JIS / windows-31j CSV sources need the extended charset list.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "townrisk",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  A private folder is made only on a local master with the setting
    unset (tests, bench); elsewhere a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="townrisk-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables: the configured one, else the checkpoint folder."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


#: Paths written inside each open :func:`table_scope`, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def table_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``shared_table`` writes inside are deleted at the end, but for those written with ``keep``.

    For steps whose result is written, or reads kept tables only, when the
    scope ends. A kept table belongs to the scope around this one, if any.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _SCOPES.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def shared_table(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False,
                 options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts the lineage).

    Every call takes a new folder, so a rerun never reads a stale table; the
    files go with the scope that they are written in, else with the checkpoint
    folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if len(_SCOPES) > keep:
        _SCOPES[-1 - keep].append(path)
    w = df.write.options(**{"compression": "zstd"} | (options or {}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's modules, once per application.

    The zip is built on the driver and handed out by Spark, so Python
    functions work whatever PYTHONPATH the workers have.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(root)
    target = os.path.join(tempfile.mkdtemp(prefix="townrisk-zip-"), "townrisk.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
