"""Queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import decontaminate, license_scan, line_dedup, near_dedup, packing, periodic_runs, quality_classifier, quality_rules, reshard, spelling_variants, suffix_dedup, token_counts, vector_links


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_min_cost_reshard": reshard.op1_min_cost_reshard,
        "op2_distribution_divergence": quality_rules.op2_distribution_divergence,
        "op3_co_training": quality_classifier.op3_co_training,
        "op4_longest_match_counts": token_counts.op4_longest_match_counts,
        "op5_order_minhash": near_dedup.op5_order_minhash,
        "op6_dynamic_packing": packing.op6_dynamic_packing,
        "op7_logarithmic_suffix_arrays": suffix_dedup.op7_logarithmic_suffix_arrays,
        "op8_diagonal_voting": license_scan.op8_diagonal_voting,
        "op9_rare_seed_alignment": decontaminate.op9_rare_seed_alignment,
        "op10_perfect_hash_lines": line_dedup.op10_perfect_hash_lines,
        "op11_tiled_principal_links": vector_links.op11_tiled_principal_links,
        "op12_difference_cover_runs": periodic_runs.op12_difference_cover_runs,
        "op13_variable_gram_variants": spelling_variants.op13_variable_gram_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_distribution_divergence": quality_rules.ORACLE,
        "op7_logarithmic_suffix_arrays": suffix_dedup.ORACLE,
        "op10_perfect_hash_lines": line_dedup.ORACLE,
        "op11_tiled_principal_links": vector_links.ORACLE,
    }
