"""Data-quality queries and the streaming twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.quality import byte_batches, infer_types, pk_violations, sql_literal_row
from ..sources import testdata as T
from .common import round_doubles
from .crime_queries import q_mart_crime
from .marts import mart_hazard


def q_infer_types(spark: SparkSession, d: str) -> DataFrame:
    return infer_types(mart_hazard(spark, d), K.FORCE_TEXT)


def q_pk_violations(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, l_linenumber) is not a key of the point source."""
    li = T.table(spark, d, "lineitem")
    return pk_violations(li, ["l_orderkey", "l_linenumber"])


def q_mart_pk_check(spark: SparkSession, d: str) -> DataFrame:
    m = q_mart_crime(spark, d)
    v = pk_violations(m, ["key", "data_year"])
    return v.agg(F.count(F.lit(1)).alias("violating_keys"))


def q_byte_batches(spark: SparkSession, d: str) -> DataFrame:
    m = q_mart_crime(spark, d)
    rows = sql_literal_row(m, text_cols=()).withColumn("key", F.col("row_text"))
    return byte_batches(rows, "key", K.MAX_BATCH_BYTES, partitions=8)


def q_stream_zone_stats(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.zone_stream import zone_stats_stream
    s = zone_stats_stream(spark, d)
    return round_doubles(s.select("zone", F.col("n").cast("long").alias("n"),
                                  F.col("n_flood").cast("long").alias("n_flood"),
                                  "depth_sum", "depth_max", "elev_sum", "elev_min"))


def q_byte_batch_totals(spark: SparkSession, d: str) -> DataFrame:
    """Partition-independent summary of the batches: every row is in one
    batch, bytes add up, and no batch exceeds the limit unless it holds a
    single oversize row."""
    b = q_byte_batches(spark, d)
    ok = (F.col("n_bytes") <= K.MAX_BATCH_BYTES) | (F.col("n_rows") == 1)
    return b.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"),
                 F.bool_and(ok).alias("within_limit"))
