"""Data-quality and export helpers: type profiling, key checks, set
equality, byte-bounded batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INT_RE = r"^\s*[+-]?[0-9]+\s*$"
REAL_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"


def infer_types(df: DataFrame, force_text: Sequence[str] = ()) -> DataFrame:
    """Column type from its text values, one pass over the data:
    empty values are skipped; all integers -> INTEGER; any real -> REAL;
    anything else -> TEXT; forced columns -> TEXT; no values -> INTEGER.
    Output: (column, position, type)."""
    flags = []
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`").cast("string")
        other = F.coalesce((v != "") & ~v.rlike(INT_RE), F.lit(False))
        flags += [F.count_if(other & ~v.rlike(REAL_RE)).alias(f"t{i}"), F.count_if(other & v.rlike(REAL_RE)).alias(f"r{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"), F.col(f"t{i}").alias("n_text"),
                              F.col(f"r{i}").alias("n_real")) for i, c in enumerate(df.columns)])
    # one row of two counts per column, unpivoted afterwards
    g = df.agg(*flags).select(F.explode(rows).alias("s")).select("s.*")
    t = (F.when(F.col("column").isin(*force_text), "TEXT") if force_text else F.lit(None))
    t = F.coalesce(t, F.when(F.col("n_text") > 0, "TEXT").when(F.col("n_real") > 0, "REAL")
                   .otherwise("INTEGER"))
    return g.select("column", F.col("pos").cast("long").alias("pos"), t.alias("type"))


def pk_violations(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their row count."""
    return df.groupBy(*pk).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def set_difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only in a / only in b (multiset semantics) as one row."""
    right = b.exceptAll(a).agg(F.count(F.lit(1))).scalar()
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left"), right.alias("only_right"))


def sql_literal_row(df: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    """Each row as one SQL VALUES tuple text, with its UTF-8 byte length."""
    parts = []
    for c in df.columns:
        v = F.col(c)
        if c in text_cols:
            lit = F.concat(F.lit("'"), F.replace(v.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        else:
            lit = v.cast("string")
        parts.append(F.coalesce(lit, F.lit("NULL")))
    txt = F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))
    return df.select(txt.alias("row_text")).withColumn("n_bytes", F.octet_length("row_text"))


BATCH_SCHEMA = "part int, batch long, n_rows long, n_bytes long"


def _greedy(limit: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        batch, size, rows = 0, 0, 0
        out = []
        for pdf in it:
            for n in pdf["n_bytes"].to_numpy():
                n = int(n)
                if rows and size + n > limit:
                    out.append((part, batch, rows, size))
                    batch, size, rows = batch + 1, 0, 0
                size += n
                rows += 1
        if rows:
            out.append((part, batch, rows, size))
        yield pd.DataFrame(out, columns=["part", "batch", "n_rows", "n_bytes"])
    return run


def byte_batches(rows: DataFrame, order: str, limit: int, partitions: int) -> DataFrame:
    """Greedy batches of at most ``limit`` bytes in ``order``; a single row
    larger than the limit forms its own batch.  Range partitioning spreads
    the work; batches restart at partition borders (the only difference to
    a single sequential pass)."""
    r = rows.repartitionByRange(partitions, order).sortWithinPartitions(order)
    return r.select("n_bytes").mapInPandas(_greedy(limit), BATCH_SCHEMA)
