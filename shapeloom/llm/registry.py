"""Queries of the text operators and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, languages, licenses, near_dup, packing, substring_dedup, token_counts, token_files, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_language_id": languages.op2_language_id,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_files": token_files.op7_token_files,
    "op8_minhash_near_dup": near_dup.op8_minhash_near_dup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_license_scan": licenses.op10_license_scan,
}
ORACLES = {
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
