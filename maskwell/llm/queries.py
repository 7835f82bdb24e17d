"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from . import bloom_lm, dartminhash, mixing, packing, quality_rules, rule_ensemble, secrets, tiff, tokens, toxicity


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_token_counts": tokens.op3_token_counts,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_dartminhash": dartminhash.op5_dartminhash,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_tiff_media": tiff.op7_tiff_media,
        "op8_rule_ensemble": rule_ensemble.op8_rule_ensemble,
        "op9_mixing": mixing.op9_mixing,
        "op10_bloom_lm": bloom_lm.op10_bloom_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_rules": quality_rules.OP6_SQL,
        "op9_mixing": mixing.OP9_SQL,
    }
