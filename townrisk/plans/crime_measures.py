"""Crime tables with one column per kind -> groups, safety axis, served measures, evidence.

The functions take DataFrames, so the same code runs on the readers' tables
(:func:`from_files`) and on the test tables' mapping (:func:`measures`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..sources import files
from ..sources import testdata as T
from ..sources.staging import staged, written
from . import serve as S
from .common import round_doubles
from .safety import scored

GROUPS = {"violent_r": K.VIOLENT, "burglary_r": K.BURGLARY, "serious_r": K.VIOLENT + K.BURGLARY,
          "daily": K.DAILY_THEFTS, "visitor": K.VISITOR_CRIMES}
COUNTED = tuple(dict.fromkeys(K.VIOLENT + K.BURGLARY + K.DAILY_THEFTS + K.VISITOR_CRIMES + (K.CRIME_TOTAL,)))


def row_sum(columns: Sequence[str]) -> Column:
    """Sum over a list of columns; a missing count is 0."""
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0))
    return total


def crime_groups(areas: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """areas (key, ward, town, pop) with the groups' counts and the served measures of both years.

    Both crime tables are summed up by key first, so a repeated key can't fan
    the joins out; an area without a row in them has counts of 0.
    """
    sums = {**GROUPS, **K.CRIME_MEASURES}
    cur = current.groupBy("key").agg(*[F.sum(row_sum(c)).alias(name) for name, c in sums.items()])
    prev = previous.groupBy("key").agg(F.sum(row_sum(GROUPS["serious_r"])).alias("serious_prev"))
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*sums, "serious_prev")]
    m = areas.join(cur, "key", "left").join(prev, "key", "left").select("key", "ward", "town", "pop", *filled)
    return m.withColumn("serious", F.col("serious_r") + F.col("serious_prev"))


def safety_axis(areas: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """The groups and measures per area with rates, group scores and safety_score."""
    return scored(written(crime_groups(areas, current, previous), "crime-groups"))


def from_files(spark: SparkSession, current: str, previous: str, population: str) -> DataFrame:
    """The safety axis from the crime tables of two years and the population table."""
    return safety_axis(files.load_population(spark, population), files.load_crime(spark, current, COUNTED),
                       files.load_crime(spark, previous, COUNTED))


def measures(spark: SparkSession, d: str) -> DataFrame:
    """The safety axis of the test tables, staged once."""
    return staged(spark, "crime_measures", d, lambda: safety_axis(
        T.areas(spark, d), T.incident_kinds(spark, d, K.CURRENT_YEAR), T.incident_kinds(spark, d, K.PREVIOUS_YEAR)))


def crime_mart(m: DataFrame) -> DataFrame:
    """The served crime table: 16 measures a key and data year."""
    return m.select("key", F.lit(K.DATA_YEAR).alias("data_year"), *K.CRIME_MEASURES,
                    F.col("serious").alias("serious_2y"), "serious_r", F.col("daily").alias("daily_r"))


def safety_evidence(m: DataFrame) -> DataFrame:
    """(key, axis, idx, label, value): the seven facts behind a safety score."""
    items = [("serious crimes (2 years)", F.col("serious")), ("robbery", F.col("robbery")),
             ("assault and injury", F.col("assault") + F.col("injury")), ("residential burglary", F.col("burglary")),
             ("bicycle theft", F.col("bicycle")), ("snatching", F.col("snatch")), ("residents", F.col("pop"))]
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), F.lit(label).alias("label"), S.fmt_int(v).alias("value"))
                     for i, (label, v) in enumerate(items)])
    return m.select("key", F.lit("safety").alias("axis"), F.inline(rows))


def q_crime_groups(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(measures(spark, d).select("key", *GROUPS, "serious_prev", "serious", "serious_score", "daily_score",
                                                   "safety_score"))


def q_mart_crime_full(spark: SparkSession, d: str) -> DataFrame:
    return crime_mart(measures(spark, d))


def q_safety_evidence(spark: SparkSession, d: str) -> DataFrame:
    return safety_evidence(measures(spark, d))
