"""The opN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from . import classify, decontaminate, embedding_dedup, line_dedup, lm_score, media, mixing, near_dedup, ranked, substring_dedup, tokens, variants

QUERIES = {
    "op1_toxicity": classify.op1_toxicity,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_minhash_setsketch": near_dedup.op6_minhash_setsketch,
    "op7_media_png": media.op7_media_png,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_suffix_dedup": substring_dedup.op9_suffix_dedup,
    "op10_quality": classify.op10_quality,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_embedding_dedup": embedding_dedup.op12_embedding_dedup,
    "op13_spelling_variants": variants.op13_spelling_variants,
}
ORACLES = {
    "op2_line_dedup": line_dedup.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op5_mix_sources": mixing.SQL,
    "op6_minhash_setsketch": near_dedup.SQL,
    "op11_ranked_search": ranked.SQL,
    "op12_embedding_dedup": embedding_dedup.SQL,
    "op13_spelling_variants": variants.SQL,
}
