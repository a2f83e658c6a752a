"""Registered queries of the corpus operators and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from veilsift.llm import bpe, chat, exact_dedup, jaccard, licenses, line_dedup, mixing, ppm, quality, secrets

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_mix": mixing.op3_mix,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality": quality.op5_quality,
    "op6_secrets": secrets.op6_secrets,
    "op7_licenses": licenses.op7_licenses,
    "op8_chat": chat.op8_chat,
    "op9_lm": ppm.op9_lm,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
}

ORACLE = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op3_mix": mixing.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_quality": quality.OP5_SQL,
    "op7_licenses": licenses.OP7_SQL,
    "op8_chat": chat.OP8_SQL,
    "op10_jaccard_join": jaccard.OP10_SQL,
}
