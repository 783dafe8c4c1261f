"""Per-zone depth statistics as a Structured Streaming query.

The accumulators (count, flooded count, sums, max, min) are mergeable, so
the same aggregate runs incrementally: a file stream of the point files,
a stream-static join with the zone cell table, and a stateful
``groupBy(zone)`` kept in the state store.  ``availableNow`` processes
everything present and stops; new files are picked up by the next run
from the checkpoint.  The result equals the batch query.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.zones import join_zones
from ..session import ensure_checkpoint_dir
from ..sources import testdata as T
from .versions import VersionedTable


def zone_stats_stream(spark: SparkSession, d: str, out_dir: str | None = None,
                      files_per_trigger: int | None = None, state_partitions: int | None = None,
                      source_dir: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the stream to completion (``availableNow``) and return the result.

    The number of state-store partitions is fixed when a query first starts
    (it is recorded in the checkpoint); it is sized to the cluster, not to
    the session's general shuffle setting.  Passing the same ``checkpoint``
    and ``out_dir`` again processes only files that arrived in
    ``source_dir`` since the previous run.
    """
    schema = T.table(spark, d, "lineitem").schema
    src = (spark.readStream.schema(schema)
           .option("pathGlobFilter", "lineitem*.parquet"))
    if files_per_trigger:
        src = src.option("maxFilesPerTrigger", files_per_trigger)
    src = src.parquet(source_dir or d)
    pts = T.points_from(src)
    joined = join_zones(pts, spark, d)
    agg = joined.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth") > 0).alias("n_flood"),
        F.sum("depth").alias("depth_sum"), F.max("depth").alias("depth_max"),
        F.sum("elev").alias("elev_sum"), F.min("elev").alias("elev_min"))
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = uuid.uuid4().hex[:12]
    out = out_dir or os.path.join(base, "stream-out", run)
    ckpt = checkpoint or os.path.join(base, "stream-ckpt", run)

    table = VersionedTable(spark, out, ["zone"])

    def write(batch: DataFrame, epoch: int) -> None:
        table.upsert(batch, epoch)      # update mode: the zones this batch changed

    parts = state_partitions or max(1, spark.sparkContext.defaultParallelism)
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        q = (agg.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
    q.awaitTermination()
    return table.read()
