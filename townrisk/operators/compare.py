"""Two builds of a table compared without moving rows that agree.

Each table is summed up by buckets of its key's hash: a row count and two
sums of row hashes, which don't depend on the order of rows. Tasks send these
sums only. The buckets of the first level whose sums differ are summed up again
by finer buckets, and only rows of fine buckets that differ are compared one by
one. Equal tables so move ``COARSE`` sums a task and no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COARSE, FINE = 256, 256


def _digests(df: DataFrame, bucket: Column, salt: int) -> DataFrame:
    row = [F.col(c) for c in df.columns]
    return df.groupBy(bucket.alias("_b")).agg(
        F.count("*").alias("_n"), *[F.sum(F.xxhash64(F.lit(s), *row).cast("decimal(38,0)")).alias(f"_h{s}") for s in (salt, salt + 1)])


def _differing(a: DataFrame, b: DataFrame, bucket: Column, salt: int) -> list[int]:
    x, y = _digests(a, bucket, salt), _digests(b, bucket, salt)
    y = y.select(F.col("_b").alias("_c"), *[F.col(c).alias(f"{c}_y") for c in y.columns if c != "_b"])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_y")) for c in x.columns if c != "_b"]
    both = x.join(y, F.col("_b") == F.col("_c"), "full").where(~(same[0] & same[1] & same[2]))
    return [r[0] for r in both.select(F.coalesce("_b", "_c")).collect()]  # buckets, a bounded number


def differing_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """(rows of ``a`` not in ``b``, rows of ``b`` not in ``a``, the number of fine buckets compared row by row); repeated rows count."""
    b = b.select(a.columns)
    h = F.xxhash64(*keys)
    coarse = F.pmod(h, F.lit(COARSE))
    first = _differing(a, b, coarse, 1)
    if not first:
        return a.limit(0), b.limit(0), 0
    # the fine number holds the coarse one
    fine = F.pmod(h, F.lit(COARSE * FINE))
    a1, b1 = a.where(coarse.isin(first)), b.where(coarse.isin(first))
    second = _differing(a1, b1, fine, 3)
    a2, b2 = a1.where(fine.isin(second)), b1.where(fine.isin(second))
    return a2.exceptAll(b2), b2.exceptAll(a2), len(second)
