"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each result as Parquet in the shared folder and reads it
back as the next stage's documents.

Null and empty texts fail the first stage's base rules (fewer than 20 words), a
null in another column is kept as it is. Texts are taken whole, whatever their
length. Of rows that repeat, or tie as copies, one with the smallest doc_id
stays. Columns beside those of documents pass through all stages but the last.
An empty table gives empty results at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townrisk.llm.common import split_by_ids
from townrisk.llm.exact_dedup import BLANKS, exact_dedup, sql_str
from townrisk.llm.minhash import near_duplicates
from townrisk.llm.packing import pack
from townrisk.llm.quality_rules import quality_filtered
from townrisk.llm.secrets import redacted
from townrisk.session import shared_folder, shared_table, ship_package, table_scope


def _staying(docs: DataFrame, verdicts: DataFrame, same: list[str]) -> DataFrame:
    """The rows of ``docs`` whose doc_id stays; where ids repeat, one of the rows equal in ``same``."""
    verdicts = shared_table(verdicts.select("doc_id", "kept"), "verdicts")
    ids = shared_table(verdicts.filter("kept").select(F.col("doc_id").alias("_stays")).distinct(), "staying")
    # every id has a verdict, so one without a verdict against it stays; only the others' texts move
    sure, rest = split_by_ids(docs, "doc_id", verdicts.filter("not kept").select("doc_id").distinct())
    rest = sure.unionByName(rest.join(ids, rest.doc_id.eqNullSafe(ids._stays), "left_semi"))
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rest
    return rest.dropDuplicates(same)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or an admitted cutoff reject go."""
    return quality_filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    verdicts = shared_table(exact_dedup(docs).select("doc_id", "kept", "text_sha256"), "verdicts")
    sure, rest = split_by_ids(docs, "doc_id", verdicts.filter("not kept").select("doc_id").distinct())
    # an id can stand on several texts, so a verdict belongs to the id and the normalised text
    digest = F.expr(f"sha2(regexp_replace(coalesce(text, ''), {sql_str(BLANKS)}, ' '), 256)")
    stays = shared_table(verdicts.filter("kept").select(F.col("doc_id").alias("_stays"), "text_sha256").distinct(), "staying")
    rows = rest.withColumn("_digest", digest)
    rest = sure.unionByName(rows.join(stays, rows.doc_id.eqNullSafe(stays._stays) & (rows._digest == stays.text_sha256), "left_semi")
                            .select(*docs.columns))
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rest = rest.withColumn("_digest", digest).dropDuplicates(["doc_id", "_digest"])
    return rest.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near-duplicates the smallest doc_id stays."""
    ship_package(spark)
    return _staying(docs, near_duplicates(docs), ["doc_id", "text"])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    ship_package(spark)
    return redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in training sequences."""
    ship_package(spark)
    return pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("secret scans", secrets),
          ("packing", packing)]

#: Packing and the forest have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with table_scope(spark):  # a stage's own tables go when its output is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
