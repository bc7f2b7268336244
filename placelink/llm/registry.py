"""Queries and oracle SQL of the document operators."""

from __future__ import annotations

from . import exact_dedup, fingerprints, langid, line_dedup, mixing, ngram_join, packing, sentence_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_sentence_span_dedup": sentence_dedup.op2_sentence_span_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_suffix_array_dedup": suffix_dedup.op6_suffix_array_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_imatch_fingerprints": fingerprints.op10_imatch_fingerprints,
}
ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
}
