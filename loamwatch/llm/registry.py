"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from loamwatch.llm import decontaminate, fill_middle, line_dedup, merges, passages, pii, quality, secrets, sentencepieces, simhash, token_counts, token_store, vector_codes

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_simhash_dedup": simhash.op3_simhash_dedup,
    "op4_personal_data": pii.op4_personal_data,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_substring_dedup": passages.op6_substring_dedup,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_sentencepiece": sentencepieces.op8_sentencepiece,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_token_ids": token_store.op10_token_ids,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_bpe": merges.op13_bpe,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op2_line_dedup": line_dedup.ORACLE, "op5_quality_rules": quality.ORACLE, "op11_fill_middle": fill_middle.ORACLE, "op12_vector_codes": vector_codes.ORACLE}
