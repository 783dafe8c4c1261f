"""Connected components over an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table, table_scope


def components(edges: DataFrame) -> DataFrame:
    """id, comp (smallest id reachable) for every id in ``edges`` (columns a, b).

    Each round takes the smallest label of the neighbours (pre-aggregated, so a
    vertex with very many neighbours is one row per task), then the label of
    the label. Labels live in written tables, dropped but for the last; only a
    count reaches the driver.
    """
    with table_scope(edges.sparkSession):
        both = shared_table(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
                            .union(edges.select("b", "a")).filter("u <> v"), "edges")
        labels = shared_table(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("v"))
                              .select("id", F.least("id", "v").alias("comp")), "labels")
        while True:
            near = (both.join(labels.select(F.col("id").alias("v"), "comp"), "v")
                    .groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("near")))
            step = shared_table(labels.join(near, "id").select(
                "id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "labels")
            up = step.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
            new = shared_table(step.join(up, "comp", "left").select(
                "id", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
            if new.filter("comp <> old").isEmpty():
                return shared_table(new.select("id", "comp"), "components", keep=True)
            labels = new.select("id", "comp")
