"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import (
    bpe, clustering, decontaminate, embedding_dedup, exact_dedup, html_text, lm_score, near_dedup, suffix_dedup,
    token_counts, toxicity, url_filter, vector_codes,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_bpe": bpe.op3_bpe,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_html_text": html_text.op9_html_text,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_embedding_dedup": embedding_dedup.op12_embedding_dedup,
    "op13_centroid_clusters": clustering.op13_centroid_clusters,
}

ORACLE = {
    "op7_near_dedup": near_dedup.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_embedding_dedup": embedding_dedup.SQL,
    "op13_centroid_clusters": clustering.SQL,
}
