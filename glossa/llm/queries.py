"""The registered queries of this package: one for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import html_text, minhash, mixing, packing, pii, quality, sharding, substrings, token_files, topk

QUERIES = {
    "op1_suffix_array_dedup": substrings.op1,
    "op2_html_extraction": html_text.op2,
    "op3_minhash_near_dedup": minhash.op3,
    "op4_sharding": sharding.op4,
    "op5_token_files": token_files.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_exact_top_k": topk.op7,
    "op8_quality_rules": quality.op8,
    "op9_pii": pii.op9,
    "op10_source_mixing": mixing.op10,
}

ORACLE_SQL = {
    "op4_sharding": sharding.OP4_SQL,
    "op7_exact_top_k": topk.OP7_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op10_source_mixing": mixing.OP10_SQL,
}
