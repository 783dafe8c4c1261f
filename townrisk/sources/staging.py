"""Staging layer: materialise small intermediate tables once.

``staged`` keeps one Parquet copy of a derived table per Spark application
and input folder (zone polygons, per-zone axis tables) in the shared folder:
every later plan starts from a pruned, pushed-down scan instead of
re-deriving it.
``materialize`` is the persistent variant: a Parquet table in a shared
folder, reused while its ``_SUCCESS`` marker exists unless a rebuild is
requested.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MEMO: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, name: str, sf_dir: str,
           build: Callable[[], DataFrame], rebuild: bool = False,
           partition_by: list[str] | None = None, cluster_by: list[str] | None = None) -> DataFrame:
    """The staged table; with ``cluster_by`` it is laid out for reads of few keys, as :func:`clustered` says."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if rebuild or key not in _MEMO:
        from ..session import shared_table
        if cluster_by:
            _MEMO[key] = clustered(build(), name, cluster_by, partition_by)
        else:
            _MEMO[key] = shared_table(build(), name, partition_by)
    return _MEMO[key]


def clustered(df: DataFrame, name: str, keys: list[str], partition_by: list[str] | None = None,
              options: dict[str, str] | None = None) -> DataFrame:
    """A Parquet copy whose files hold ranges of ``keys`` in order, with a Bloom filter on the first of them.

    A filter on the first key then reads the row groups whose bounds hold the
    value, and of those only the ones whose Bloom filter doesn't rule it out.
    The range partitioning samples, so a hot first key is spread if there are
    further keys.
    """
    from ..session import shared_table
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*(partition_by or []), *keys)
    return shared_table(laid, name, partition_by, options={f"parquet.bloom.filter.enabled#{keys[0]}": "true"} | (options or {}))


def written(df: DataFrame, name: str) -> DataFrame:
    """A Parquet copy in the shared folder, for a result that several plans read."""
    from ..session import shared_table
    return shared_table(df, name)


def clear_staged() -> None:
    _MEMO.clear()


@contextmanager
def unstaged() -> Iterator[None]:
    """Inside, no staged table is reused: everything is built from the sources."""
    held = dict(_MEMO)
    _MEMO.clear()
    try:
        yield
    finally:
        _MEMO.clear()
        _MEMO.update(held)


def _hadoop_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def materialize(spark: SparkSession, df_or_build, path: str, rebuild: bool = False,
                partition_by: list[str] | None = None) -> DataFrame:
    """Write a Parquet table once and read it back; reuse it if complete."""
    if rebuild or not _hadoop_exists(spark, os.path.join(path, "_SUCCESS")):
        df = df_or_build() if callable(df_or_build) else df_or_build
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
    return spark.read.parquet(path)
