"""A keyed table that a stream updates: every epoch adds the rows that changed.

An epoch's rows are written to a folder of their own and entered once; an epoch
that is replayed finds its entry and writes nothing, and readers, who take the
newest version of every key among entered epochs, never see half an epoch.
Every ``FOLD`` epochs the newest versions are written as one base, so that a
reader takes the latest base and a bounded number of epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.chunked import ChunkedBuild

FOLD = 16


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.keys = keys
        self.build = ChunkedBuild(spark, path, "versions")

    def upsert(self, changed: DataFrame, epoch: int) -> bool:
        """Enters the rows of an epoch; False if it was there already."""
        rows = changed.withColumn("_epoch", F.lit(epoch).cast("long"))
        new = bool(self.build.run([f"epoch {epoch}"], lambda _: rows))
        if new:
            self._fold()
        return new

    def _parts(self) -> tuple[list[str], list[str], int]:
        """(folders to read, of epochs only, the last epoch)."""
        done = self.build.finished()
        base = max((int(c.split()[1]) for c in done if c.startswith("base ")), default=-1)
        later = {int(c.split()[1]): f for c, f in done.items() if c.startswith("epoch ") and int(c.split()[1]) > base}
        folders = [later[e] for e in sorted(later)]
        return ([done[f"base {base}"]] if base >= 0 else []) + folders, folders, max(later, default=base)

    def _newest(self, folders: list[str]) -> DataFrame:
        rows = self.build.spark.read.parquet(*folders)
        rest = [c for c in rows.columns if c not in self.keys and c != "_epoch"]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_v"), F.max("_epoch").alias("_epoch"))
        return newest.select(*self.keys, *[F.col(f"_v.{c}").alias(c) for c in rest], "_epoch")

    def _fold(self) -> None:
        folders, epochs, last = self._parts()
        if len(epochs) >= FOLD:
            self.build.run([f"base {last}"], lambda _: self._newest(folders))

    def read(self) -> DataFrame:
        """The newest row of every key."""
        folders, _, _ = self._parts()
        if not folders:
            raise ValueError(f"no epoch has been entered in {self.build.path}")
        return self._newest(folders).drop("_epoch")
