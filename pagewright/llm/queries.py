"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import anchors, centroids, decontam, lm, mixing, near, rules, simhash, suffixes, tokens, toxicity, warc, wrappers

QUERIES = {
    "op1_near_duplicates": near.op1_near_duplicates,
    "op2_warc": warc.op2_warc,
    "op3_main_text": wrappers.op3_main_text,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_repeated_passages": suffixes.op5_repeated_passages,
    "op6_quality_rules": rules.op6_quality_rules,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_quality_classifier": lm.op9_quality_classifier,
    "op10_mixing": mixing.op10_mixing,
    "op11_vector_codes": anchors.op11_vector_codes,
    "op12_simhash": simhash.op12_simhash,
    "op13_centroids": centroids.op13_centroids,
}

ORACLE_SQL = {
    "op1_near_duplicates": near.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op5_repeated_passages": suffixes.OP5_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_vector_codes": anchors.OP11_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
