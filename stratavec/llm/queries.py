"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_fst import round_trip_public
from .common import table
from .divergence import AUDIT_SQL, audit_sources
from .exact_dedup import EXACT_SQL, exact_groups
from .fim import FIM_SQL, fill_in_middle
from .hash_forest import nearest
from .language_id import language_id
from .license_scan import license_sql, scan_licenses
from .near_dedup import NEAR_SQL, NearSettings, near_groups
from .packing import pack_with_public
from .pii import find_pii
from .token_count import count_tokens_afresh
from .topk_search import TOP_K_SQL, top_k
from .toxicity import toxicity_of_tables


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("found")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_of_tables(spark, sf_dir)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), NearSettings(percent=85, matches=14))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens_afresh(table(spark, sf_dir, "documents"))


def op8_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_public(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_with_public(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op13_approximate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_toxicity": op2_toxicity,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_near_dedup": op4_near_dedup,
        "op5_license_scan": op5_license_scan,
        "op6_language_id": op6_language_id,
        "op7_token_count": op7_token_count,
        "op8_top_k_search": op8_top_k_search,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_packing": op10_packing,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_source_divergence": op12_source_divergence,
        "op13_approximate_nearest": op13_approximate_nearest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": EXACT_SQL,
        "op4_near_dedup": NEAR_SQL,
        "op5_license_scan": license_sql(),
        "op8_top_k_search": TOP_K_SQL,
        "op11_fill_in_middle": FIM_SQL,
        "op12_source_divergence": AUDIT_SQL,
    }
