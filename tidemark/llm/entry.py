"""Queries and SQL of this subpackage, for the registry at the repository's top."""

from __future__ import annotations

from . import op1_flac, op10_jaccard, op11_quality, op12_merkle, op13_alignment, op2_toxicity, op3_exact_dedup, op4_backoff_lm, op5_token_store, op6_secrets, op7_mixing, op8_language, op9_byte_bpe

QUERIES = {
    "op1_flac": op1_flac.query,
    "op2_toxicity": op2_toxicity.query,
    "op3_exact_dedup": op3_exact_dedup.query,
    "op4_backoff_lm": op4_backoff_lm.query,
    "op5_token_store": op5_token_store.query,
    "op6_secrets": op6_secrets.query,
    "op7_mixing": op7_mixing.query,
    "op8_language": op8_language.query,
    "op9_byte_bpe": op9_byte_bpe.query,
    "op10_jaccard": op10_jaccard.query,
    "op11_quality": op11_quality.query,
    "op12_merkle": op12_merkle.query,
    "op13_alignment": op13_alignment.query,
}

ORACLE_SQL = {
    "op3_exact_dedup": op3_exact_dedup.ORACLE,
    "op7_mixing": op7_mixing.ORACLE,
    "op11_quality": op11_quality.ORACLE,
    "op12_merkle": op12_merkle.ORACLE,
}
