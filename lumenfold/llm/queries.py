"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from lumenfold.llm import bpe, conversation_repair, exact_dedup, fingerprint, jaccard_join, license_scan, mixing, piece_bpe, quality, secret_scan, sharding, spelling, substring_dedup

MODULES = (mixing, secret_scan, bpe, fingerprint, sharding, quality, exact_dedup, license_scan, substring_dedup, jaccard_join, piece_bpe, spelling, conversation_repair)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_bpe": bpe.op3_bpe,
    "op4_fingerprints": fingerprint.op4_fingerprints,
    "op5_sharding": sharding.op5_sharding,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_piece_bpe": piece_bpe.op11_piece_bpe,
    "op12_spelling": spelling.op12_spelling,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLES = {k: v for m in MODULES for k, v in m.SQL.items()}
