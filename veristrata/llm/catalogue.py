"""The queries of this subpackage and, where SQL can state them, their DuckDB twins."""

from __future__ import annotations

from veristrata.llm import decontaminate, langid, licenses, lm_score, mixing, near_dedup, pii, pu_quality, quality_rules, url_filters


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_pii": pii.op2_pii,
        "op3_licenses": licenses.op3_licenses,
        "op4_minhash": near_dedup.op4_minhash,
        "op5_language_id": langid.op5_language_id,
        "op6_url_filters": url_filters.op6_url_filters,
        "op7_suffix_tree": lm_score.op7_suffix_tree,
        "op8_mixing": mixing.op8_mixing,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_pu_quality": pu_quality.op10_pu_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.OP1_SQL,
        "op4_minhash": near_dedup.OP4_SQL,
        "op6_url_filters": url_filters.OP6_SQL,
        "op8_mixing": mixing.OP8_SQL,
    }
