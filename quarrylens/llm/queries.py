"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from . import alignment, bpe_codec, exact_topk, jaccard_join, language_id, line_dedup, lm_score, mixing, pii, quality_rules, token_counts, toxicity, vector_codes

QUERIES: dict[str, Callable] = {
    "op1_lm_score": lm_score.op1,
    "op2_pii": pii.op2,
    "op3_line_dedup": line_dedup.op3,
    "op4_jaccard_join": jaccard_join.op4,
    "op5_toxicity": toxicity.op5,
    "op6_token_counts": token_counts.op6,
    "op7_exact_topk": exact_topk.op7,
    "op8_mixing": mixing.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_bpe_codec": bpe_codec.op10,
    "op11_alignment": alignment.op11,
    "op12_language_id": language_id.op12,
    "op13_vector_codes": vector_codes.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op7_exact_topk": exact_topk.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
