"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from .centroids import clusters_report
from .common import documents
from .exact_dedup import exact_dedup
from .language import identify
from .merkle import manifest_report
from .minhash import near_duplicates
from .nbest import encoding_report
from .oracle import SQL
from .packing import pack
from .pii import personal_report
from .quality_rules import quality_rules
from .secrets import secrets_report
from .suffix_dedup import remove_repeats
from .token_files import token_files_report
from .warc import round_trip


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_language_hierarchy(spark, sf_dir):
    return identify(documents(spark, sf_dir))


def op3_pii_disclosure(spark, sf_dir):
    return personal_report(documents(spark, sf_dir))


def op4_minhash_bayes(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


def op5_warc_splittable(spark, sf_dir):
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_quality_rules(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(documents(spark, sf_dir), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pack_sequences(spark, sf_dir):
    return pack(documents(spark, sf_dir))


def op8_nbest_pieces(spark, sf_dir):
    return encoding_report(documents(spark, sf_dir))


def op9_secret_forest(spark, sf_dir):
    return secrets_report(documents(spark, sf_dir))


def op10_suffix_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_token_files(spark, sf_dir):
    return token_files_report(documents(spark, sf_dir))


def op12_merkle_manifest(spark, sf_dir):
    return manifest_report(documents(spark, sf_dir))


def op13_centroid_clusters(spark, sf_dir):
    return clusters_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_language_hierarchy, op3_pii_disclosure, op4_minhash_bayes, op5_warc_splittable, op6_quality_rules,
                                     op7_pack_sequences, op8_nbest_pieces, op9_secret_forest, op10_suffix_dedup, op11_token_files, op12_merkle_manifest, op13_centroid_clusters)}
ORACLE = {k: v for k, v in SQL.items() if k in QUERIES}
