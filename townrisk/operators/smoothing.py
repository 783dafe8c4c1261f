"""Empirical-Bayes smoothing of rare-event rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smooth_rate(df: DataFrame, count: str, pop: str, years: float, out: str,
                prior: float = 2.0, valid: Column | None = None,
                per: float = 1000.0) -> DataFrame:
    """rate = (count + prior) / (pop*years + prior/r0) * per.

    r0 = sum(count) / sum(pop*years) over ALL rows of ``df`` (gated rows
    included), computed once as a scalar subquery.  r0 == 0 or a
    zero denominator give NULL instead of inf/NaN.
    """
    # r0 is a scalar subquery: evaluated once, no join
    r0 = df.agg(F.try_divide(F.sum(F.col(count).cast("double")),
                             F.sum(F.col(pop) * F.lit(float(years))))).scalar()
    pseudo = F.try_divide(F.lit(float(prior)), r0)
    rate = F.try_divide(F.col(count) + F.lit(float(prior)),
                        F.col(pop) * F.lit(float(years)) + pseudo) * F.lit(per)
    if valid is not None:
        rate = F.when(F.coalesce(valid, F.lit(False)), rate)
    return df.withColumn(out, rate)
