"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

1. The blank-normalised text is cut where its own characters say so, so equal
   texts have equal chunks wherever they are stored.
2. Chunks are deduplicated (map-side first, then one shuffle that moves each
   distinct chunk once per task) and get a verified identifier: the 64-bit
   fingerprint plus the chunk's rank among different chunk texts of that
   fingerprint, which is 0 unless fingerprints collide.
3. A document's recipe is its ordered list of identifiers. Documents are grouped
   and joined on the recipe alone; no whole text is shuffled.

Edge cases: a null text counts as empty; empty texts are equal and have the
empty recipe; rows with a null doc_id take part, but never name a group that
has another id; rows that repeat a doc_id with an equal text share its verdict;
other columns of the input, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table
from .common import BLANKS, sql_str

#: A cut falls behind these characters; about one place in 190 of Latin prose.
CUT_BEHIND = "[b-l][aeou] [c-m]"
MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunk_pattern(shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> str:
    """Matches chunk after chunk without gaps: up to the first cut, else ``longest`` characters."""
    return f"(?s).{{{shortest},{longest}}}?(?<={CUT_BEHIND})|.{{1,{longest}}}"


def chunked(docs: DataFrame, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> DataFrame:
    """doc_id, norm (normalised text), chunks (array of strings)."""
    norm = f"regexp_replace(coalesce(text, ''), {sql_str(BLANKS)}, ' ')"
    pattern = sql_str(chunk_pattern(shortest, longest))
    return (docs.select("doc_id", F.expr(norm).alias("norm"))
            .withColumn("chunks", F.expr(f"regexp_extract_all(norm, {pattern}, 0)")))


def colliding_chunks(chunks: DataFrame, fingerprint: str) -> DataFrame | None:
    """chunk and its rank, where a fingerprint belongs to several chunk texts; None if none does.

    ``chunks`` has one column, chunk. Here the full chunk texts are compared:
    each distinct text moves once, and only colliding ones a second time.
    """
    distinct = chunks.select(F.expr(fingerprint).alias("fp"), "chunk").distinct()
    groups = shared_table(distinct.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"),
                          "chunk-clashes")
    if groups.isEmpty():
        return None
    # a list per fingerprint: as many texts as collide on it
    texts = distinct.join(groups, "fp").groupBy("fp").agg(F.sort_array(F.collect_list("chunk")).alias("all"))
    return texts.select(F.posexplode("all").alias("rank", "chunk")).filter("rank > 0")


def recipes(docs: DataFrame, fingerprint: str = "xxhash64(chunk)", shortest: int = MIN_CHUNK,
            longest: int = MAX_CHUNK) -> DataFrame:
    """doc_id, text_sha256, ids (fingerprints in order), marks (places whose identifier has a rank over 0)."""
    cut = chunked(docs, shortest, longest)
    clash = colliding_chunks(cut.select(F.explode("chunks").alias("chunk")), fingerprint)
    rows = cut.select("doc_id", F.expr("sha2(norm, 256)").alias("text_sha256"),
                      F.expr(f"transform(chunks, c -> {fingerprint.replace('chunk', 'c')})").alias("ids"))
    none = F.expr("cast(array() as array<string>)")
    if clash is None:
        return rows.withColumn("marks", none)
    # the text's digest only brings the places of one text together
    places = (cut.select(F.expr("sha2(norm, 256)").alias("text_sha256"),
                         F.posexplode("chunks").alias("place", "chunk"))
              .join(clash, "chunk").groupBy("text_sha256")
              .agg(F.sort_array(F.collect_set(
                  F.expr("concat(lpad(cast(place as string), 12, '0'), ':', rank)"))).alias("marks")))
    return rows.join(places, "text_sha256", "left").withColumn("marks", F.coalesce("marks", none))


def exact_dedup(docs: DataFrame, fingerprint: str = "xxhash64(chunk)", shortest: int = MIN_CHUNK,
                longest: int = MAX_CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: one row per input row.

    Groups are pre-aggregated before the shuffle, and the join back on the
    recipe is a plain equi-join whose hot keys Spark can split.
    """
    rec = shared_table(recipes(docs, fingerprint, shortest, longest), "recipes")
    # written, so that the join below deals both sides anew and Spark can split a hot recipe
    groups = shared_table(rec.groupBy("ids", "marks").agg(F.min("doc_id").alias("keep_id"),
                                                          F.count("*").alias("group_size")), "recipe-groups")
    r, g = rec.alias("r"), groups.alias("g")
    return (r.join(g, (F.col("r.ids") == F.col("g.ids")) & (F.col("r.marks") == F.col("g.marks")))
            .select("r.doc_id", "g.keep_id", "g.group_size",
                    F.expr("r.doc_id <=> g.keep_id").alias("kept"), "r.text_sha256",
                    F.expr("cast(size(r.ids) as bigint)").alias("n_chunks")))
