"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import bpe, exact_dedup, language_id, language_model, mixing, quality, simhash, substring_dedup, topk, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_bpe": bpe.op2_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_language_model": language_model.op4_language_model,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_topk": topk.op9_topk,
    "op10_language_id": language_id.op10_language_id,
}

SQL = {
    "op1_warc": warc.OP1_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_topk": topk.OP9_SQL,
}
