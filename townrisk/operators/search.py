"""Substring search by an index of trigrams.

One row (gram, name) per distinct trigram of a name's search key, laid out by
gram. The key is padded at its end, so that a trigram begins at each of its
characters and a query of one or two characters is the beginning of one.

A query reads the rows of its rarest trigram only (every name with all its
trigrams is among them) and verifies them against the whole query; the names
themselves are not scanned. Names with a null search key are not indexed, an
empty query matches all names and needs no index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3
PAD = "\x01"


def trigram_rows(names: DataFrame, key: str = "search_key") -> DataFrame:
    """``names`` once per distinct trigram of ``key``, with the trigram as column ``gram``."""
    padded = F.concat(F.col(key), F.lit(PAD * (WIDTH - 1)))
    starts = F.sequence(F.lit(1), F.length(key))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr(padded, i, F.lit(WIDTH))))
    return names.where(F.length(key) > 0).select("*", F.explode(grams).alias("gram"))


def gram_counts(index: DataFrame) -> DataFrame:
    """gram, names: by how many names each trigram is held."""
    return index.groupBy("gram").agg(F.count("*").alias("names"))


def containing(index: DataFrame, counts: DataFrame, query: str, key: str = "search_key") -> DataFrame:
    """Rows of the names whose ``key`` contains ``query`` (not empty), one per name; ``gram`` is dropped.

    Only the counts of the query's own trigrams come to the driver.
    """
    if len(query) < WIDTH:
        # a name has a row for every trigram that begins so; the one of the first place in the key stays
        rows = index.where(F.col("gram").startswith(query))
        padded = F.concat(F.col(key), F.lit(PAD * (WIDTH - 1)))
        first = F.substr(padded, F.instr(F.col(key), F.lit(query)), F.lit(WIDTH))
        return rows.where(F.col("gram") == first).drop("gram")
    grams = sorted({query[i:i + WIDTH] for i in range(len(query) - WIDTH + 1)})
    held = {r["gram"]: r["names"] for r in counts.where(F.col("gram").isin(grams)).collect()}
    rarest = min(grams, key=lambda g: (held.get(g, 0), g))
    return index.where((F.col("gram") == rarest) & F.col(key).contains(query)).drop("gram")
