"""Resumable builds: a table built chunk by chunk, with a manifest of the finished ones.

Every chunk is written to a folder of its own attempt and then entered in the
manifest by one rename that never replaces an entry. A reader takes the folders
that entries name, so an attempt that was cut off, or that another build
overtook, is never read. Entries stand under the fingerprint of the inputs and
settings; when either changes, nothing of the earlier build counts as finished.
All of it is in files that the whole cluster sees, so a build goes on after a
restart of the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def input_fingerprint(spark: SparkSession, paths: Iterable[str], settings: str = "") -> str:
    """Of the names, sizes and times of all files below ``paths``, and of ``settings``. Contents aren't read."""
    found = []
    for path in sorted(paths):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        row = files.select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h")).agg(
            F.sum("h").alias("h"), F.count("*").alias("n")).first()
        found.append((path, str(row.h), row.n))
    return hashlib.sha256(json.dumps([found, settings]).encode()).hexdigest()[:24]


class ChunkedBuild:
    """The chunks of one table under ``path`` for one fingerprint."""

    def __init__(self, spark: SparkSession, path: str, fingerprint: str):
        self.spark, self.path, self.fingerprint = spark, path.rstrip("/"), fingerprint
        jvm = spark.sparkContext._jvm
        self._fs_path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._fs_path(self.path).getFileSystem(self._conf)
        self._manifest = f"{self.path}/manifest/{fingerprint}"

    def _entry(self, chunk: str) -> str:
        return f"{self._manifest}/{hashlib.sha256(chunk.encode()).hexdigest()[:32]}.json"

    def finished(self) -> dict[str, str]:
        """Folder of every finished chunk."""
        top = self._fs_path(self._manifest)
        if not self._fs.exists(top):
            return {}
        rows = self.spark.read.schema("chunk string, folder string").option("pathGlobFilter", "*.json").json(self._manifest).collect()  # a row a chunk
        return {r.chunk: r.folder for r in rows if r.chunk is not None and r.folder is not None}

    def _commit(self, chunk: str, folder: str) -> bool:
        """Enters ``folder`` for ``chunk``; False if another attempt was first."""
        gateway = self.spark.sparkContext._gateway
        draft = self._fs_path(f"{self._manifest}/_drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"chunk": chunk, "folder": folder}, ensure_ascii=False).encode()))
        out.close()
        context = gateway.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        option = gateway.jvm.org.apache.hadoop.fs.Options.Rename
        never_replace = gateway.new_array(option, 1)
        never_replace[0] = option.NONE
        try:
            context.rename(draft, self._fs_path(self._entry(chunk)), never_replace)
        except Exception as e:  # noqa: BLE001 - the gateway's error carries the Java one
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def run(self, chunks: Iterable[str], build: Callable[[str], DataFrame]) -> list[str]:
        """Builds the chunks that aren't finished, one after the other; returns those that were built."""
        done, built = self.finished(), []
        for chunk in chunks:
            if chunk in done:
                continue
            folder = f"{self.path}/data/{self.fingerprint}/{uuid.uuid4().hex}"
            build(chunk).write.parquet(folder)
            self._commit(chunk, folder)
            built.append(chunk)
        return built

    def read(self, chunks: Iterable[str]) -> DataFrame:
        """All rows of ``chunks``, which must be finished."""
        done = self.finished()
        wanted = list(chunks)
        missing = [c for c in wanted if c not in done]
        if missing:
            raise ValueError(f"{len(missing)} chunks aren't finished: {missing[:5]}")
        return self.spark.read.parquet(*[done[c] for c in wanted])
