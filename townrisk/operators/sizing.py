"""Lineage cutting."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """A Parquet copy in the session's shared folder; whether a small table is
    broadcast afterwards is Spark's decision, from its size in bytes."""
    from ..session import shared_table
    return shared_table(df, name)
