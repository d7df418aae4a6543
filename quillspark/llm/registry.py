"""Queries of the training-data operators and the SQL that DuckDB runs for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codebooks, decontamination, exact_dedup, language_id, license_scan, mixing, ngram_join, prefix_trie, sharding, token_counts, top_k, url_filter, warc_revisit


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": ngram_join.query,
        "op2_mixing": mixing.query,
        "op3_token_counts": token_counts.query,
        "op4_balanced_shards": sharding.query,
        "op5_warc_revisit": warc_revisit.query,
        "op6_exact_dedup": exact_dedup.query,
        "op7_license_scan": license_scan.query,
        "op8_language_id": language_id.query,
        "op9_url_filter": url_filter.query,
        "op10_latent_decontamination": decontamination.query,
        "op11_vector_codes": codebooks.query,
        "op12_prefix_trie": prefix_trie.query,
        "op13_exact_top_k": top_k.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.ORACLE_SQL,
        "op5_warc_revisit": warc_revisit.ORACLE_SQL,
        "op6_exact_dedup": exact_dedup.ORACLE_SQL,
        "op9_url_filter": url_filter.ORACLE_SQL,
        "op11_vector_codes": codebooks.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
        "op13_exact_top_k": top_k.ORACLE_SQL,
    }
