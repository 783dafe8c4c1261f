"""Percentile ranks, exact quantiles and top-1 selection without a global
single-partition window.

Ranks are derived from *distinct-value counts*: the input is first reduced
to (value, count) with a partial/final hash aggregate (so a value that a
third of all rows share collapses to one row before any shuffle), each
distinct value gets an order-preserving bucket id computed from the value
itself (binary exponent + top mantissa bits, no pass over the data), the
values are counted cumulatively inside each bucket with a window
partitioned by bucket, and offset by the per-bucket totals (a table bounded
by the bucket id range).  The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SUB_BITS = 8
FINE_BITS = 12      # second bucket level, so that values close together spread
RANK_BITS = 40      # leading bits that count, so that values equal in exact arithmetic tie


def _valid_cond(value: str, valid: Column | None) -> Column:
    cond = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    if valid is not None:
        cond = cond & F.coalesce(valid, F.lit(False))
    return cond


def monotone_bucket(v: Column, sub_bits: int = 8) -> Column:
    """Order-preserving bucket id of a double, computed from the value alone.

    Buckets follow the binary exponent and the top ``sub_bits`` mantissa
    bits, so equal values always share a bucket, larger values never get a
    smaller id, and no pass over the data is needed to find borders.
    There are at most ~2 * 2100 * 2**sub_bits ids.
    """
    sub = 1 << sub_bits
    a = F.abs(v)
    e = F.floor(F.log2(a))
    frac = a / F.pow(F.lit(2.0), e) - F.lit(1.0)
    mag = F.lit(1) + (e + F.lit(1075)) * F.lit(sub) + F.floor(frac * F.lit(sub))
    return (F.when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0))).cast("long")


def rank_value(v: Column, bits: int | None) -> Column:
    """The value that is ranked: rounded to ``bits`` leading bits, at any scale."""
    v = v.cast("double")
    if bits is None:
        return v
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(v))) - F.lit(bits))
    return F.when((v == 0) | (unit == 0), v).otherwise(F.rint(v / unit) * unit)


def value_counts_ge(df: DataFrame, value: str, valid: Column | None = None,
                    sub_bits: int = DEFAULT_SUB_BITS,
                    by: Sequence[str] = (), bits: int | None = None) -> DataFrame:
    """Distinct valid values (per ``by`` group) with ``_c`` (rows with this
    value), ``_ge`` (rows with a value >= it) and ``_n`` (valid rows).

    ``sub_bits`` sets how finely each binary exponent range is split into
    buckets; each is split again by ``FINE_BITS`` more bits of the value, so
    values within a fraction of a percent still spread over many tasks.  The
    fine totals are summed inside a bucket (at most 2 ** FINE_BITS rows),
    the bucket totals over all (bounded by the bucket ids).  ``bits``
    rounds the values first.
    """
    by = list(by)
    vc = (df.where(_valid_cond(value, valid))
          .groupBy(*by, rank_value(F.col(value), bits).alias("_v"))
          .agg(F.count(F.lit(1)).alias("_c"))
          .withColumn("_bk", monotone_bucket(F.col("_v"), sub_bits))
          .withColumn("_fine", monotone_bucket(F.col("_v"), sub_bits + FINE_BITS)))
    inside = Window.partitionBy(*by, "_bk", "_fine").orderBy(F.desc("_v")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = vc.withColumn("_in", F.sum("_c").over(inside))
    fine = vc.groupBy(*by, "_bk", "_fine").agg(F.sum("_c").alias("_ft"))
    ahead = Window.partitionBy(*by, "_bk").orderBy(F.desc("_fine")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    fine_offsets = fine.select(*by, "_bk", "_fine", F.coalesce(F.sum("_ft").over(ahead), F.lit(0)).alias("_fo"))
    totals = fine.groupBy(*by, "_bk").agg(F.sum("_ft").alias("_bt"))
    above = Window.partitionBy(*by).orderBy(F.desc("_bk")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_bk",
        F.coalesce(F.sum("_bt").over(above), F.lit(0)).alias("_off"),
        F.sum("_bt").over(Window.partitionBy(*by)).alias("_n"))
    # Without groups the offsets table has one row per non-empty bucket,
    # bounded by the bucket id range whatever the input size.
    return (x.join(fine_offsets, [*by, "_bk", "_fine"]).join(offsets, [*by, "_bk"])
            .select(*by, "_v", "_c", "_n", (F.col("_off") + F.col("_fo") + F.col("_in")).alias("_ge")))


def _attach(df: DataFrame, value: str, counts: DataFrame, score: Column,
            out: str, valid: Column | None, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    scored = counts.select(*[F.col(b).alias(f"_by_{b}") for b in by],
                           F.col("_v"), score.alias("_score"))
    cond = rank_value(df[value], RANK_BITS) == scored["_v"]
    for b in by:
        cond = cond & (df[b] == scored[f"_by_{b}"])
    j = df.join(scored, cond, "left")
    return (j.withColumn(out, F.when(_valid_cond(value, valid), F.col("_score")))
            .drop("_v", "_score", *[f"_by_{b}" for b in by]))


def pct_score(df: DataFrame, value: str, out: str, valid: Column | None = None,
              sub_bits: int = DEFAULT_SUB_BITS, by: Sequence[str] = ()) -> DataFrame:
    """Smaller is better: 100 * (#valid rows with value >= v) / #valid rows.

    Ties share the highest rank, NULL / invalid rows get NULL and are left
    out of numerator and denominator.  ``by`` ranks within groups.
    """
    c = value_counts_ge(df, value, valid, sub_bits, by, RANK_BITS)
    return _attach(df, value, c, F.lit(100.0) * F.col("_ge") / F.col("_n"), out, valid, by)


def pct_scores(df: DataFrame, specs: Sequence[tuple[str, str, Column | None]],
               sub_bits: int = DEFAULT_SUB_BITS) -> DataFrame:
    """Several :func:`pct_score` columns attached to the SAME input.

    Every counts table is derived from ``df`` directly, so the plan grows
    linearly with the number of scores instead of nesting.
    """
    out = df
    for value, name, valid in specs:
        c = value_counts_ge(df, value, valid, sub_bits, bits=RANK_BITS)
        out = _attach(out, value, c, F.lit(100.0) * F.col("_ge") / F.col("_n"), name, valid)
    return out


def rank_low_pct(df: DataFrame, value: str, out: str, valid: Column | None = None,
                 sub_bits: int = DEFAULT_SUB_BITS, by: Sequence[str] = ()) -> DataFrame:
    """Larger is better: 100 * (1 + #valid rows with value < v) / #valid rows
    (ascending rank, ties share the lowest rank)."""
    c = value_counts_ge(df, value, valid, sub_bits, by, RANK_BITS)
    score = F.lit(100.0) * (F.col("_n") - F.col("_ge") + 1) / F.col("_n")
    return _attach(df, value, c, score, out, valid, by)


def quantiles(df: DataFrame, value: str, probs: Sequence[float],
              names: Sequence[str], valid: Column | None = None,
              sub_bits: int = DEFAULT_SUB_BITS, by: Sequence[str] = (),
              count_name: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row (per ``by`` group).

    Position h = (n-1)*p on the ascending order; the two neighbouring order
    statistics are the smallest values whose cumulative count (<=) reaches
    floor(h)+1 and ceil(h)+1.  No group's values are ever held together.
    """
    by = list(by)
    c = value_counts_ge(df, value, valid, sub_bits, by)
    le = F.col("_n") - F.col("_ge") + F.col("_c")
    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        aggs.append(F.min(F.when(le >= F.floor(h) + 1, F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(le >= F.ceil(h) + 1, F.col("_v"))).alias(f"_hi{i}"))
    a = c.groupBy(*by).agg(*aggs)
    cols = [F.col("_n").alias(count_name)] if count_name else []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = (F.col("_n") - 1) * F.lit(float(p))
        frac = h - F.floor(h)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        cols.append((lo + (hi - lo) * frac).alias(name))
    return a.select(*by, *cols)


def top1(df: DataFrame, keys: Sequence[str], measure: str, tie: str,
         cols: Sequence[str], prefix: str = "") -> DataFrame:
    """Per key the row with the largest ``measure``; ties -> smallest ``tie``.

    One hash aggregate with a struct minimum (partial aggregation per task),
    no sort and no window.
    """
    best = F.min(F.struct((-F.col(measure)).alias("_neg"), F.col(tie).alias("_tie"),
                          *[F.col(c).alias(c) for c in cols])).alias("_best")
    g = df.groupBy(*keys).agg(best)
    return g.select(*keys, *[F.col(f"_best.{c}").alias(prefix + c) for c in cols])


def pct_score_window(df: DataFrame, value: str, out: str,
                     valid: Column | None = None) -> DataFrame:
    """Reference form of :func:`pct_score` with one global window.

    Only for small frames and tests: the window has no partition spec, so
    all rows meet in one task.
    """
    cond = _valid_cond(value, valid)
    w = Window.orderBy(F.desc(value))
    ok = df.where(cond).withColumn(out, F.lit(100.0) * F.cume_dist().over(w))
    return ok.unionByName(df.where(~cond).withColumn(out, F.lit(None).cast("double")))
