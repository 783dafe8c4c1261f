"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_table

#: A filter of ids has at most 2^28 bits.
MOST_BITS = 28

#: Blank characters of every word rule: space and the five ASCII controls tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sql_str(text: str) -> str:
    """``text`` as a SQL literal (backslashes doubled)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def split_by_ids(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is surely none of the ids, the others), so that a join on the ids needs to move the others only.

    ``ids`` has one column. Its hashes are bits, 16 or more an id and 32 MB at
    most, dealt to the rows by a broadcast join; the rows themselves, with whole
    texts as a rule, stay where they are.
    """
    ids, kind = ids.toDF("_id"), ids.schema[0].dataType.simpleString()
    size = 1 << min(MOST_BITS, max(15, (16 * ids.count()).bit_length()))
    place = "pmod(xxhash64(cast({} as string)), %dL) + 1" % size
    bits = shared_table(ids.select(F.expr(place.format("_id")).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("_part"))
                        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("_bits")), "id-bits")
    marked = rows.withColumn("_place", F.expr(place.format(f"cast(`{key}` as {kind})"))).join(
        F.broadcast(bits), F.expr("bitmap_bucket_number(_place) = _part"), "left")
    at = "bitmap_bit_position(_place)"
    bit = F.expr(f"coalesce(shiftright(cast(conv(hex(substring(_bits, cast({at} div 8 as int) + 1, 1)), 16, 10) as int), "
                 f"cast({at} % 8 as int)) % 2 = 1, false)")
    return marked.filter(~bit).select(rows.columns), marked.filter(bit).select(rows.columns)
