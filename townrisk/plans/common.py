"""Small helpers shared by the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (float sums depend on task order)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (Ty.DoubleType, Ty.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def zero_if_null(name: str, typ: str = "long"):
    return F.coalesce(F.col(name), F.lit(0)).cast(typ).alias(name)
