"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from . import bagminhash, bitplanes, exact_dedup, fingerprint, langid, mainhtml, mixing, nbsvm, pieces, wordpiece

QUERIES = {
    "op1_main_text": mainhtml.op1_main_text,
    "op2_token_planes": bitplanes.op2_token_planes,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_quality": nbsvm.op4_quality,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_fingerprints": fingerprint.op6_fingerprints,
    "op7_token_counts": wordpiece.op7_token_counts,
    "op8_near_duplicates": bagminhash.op8_near_duplicates,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_language_id": langid.op10_language_id,
}

SQL = {
    "op5_mix_sources": mixing.OP5_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
