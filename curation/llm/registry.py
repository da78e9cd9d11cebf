"""The queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from curation.llm import bpe_counts, centroids, divergence, exact_dedup, fingerprints, jaccard_join, language_id, near_dedup, packing, piece_codec, quality, substring_dedup, warc

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_token_counts": bpe_counts.op2_token_counts,
    "op3_quality": quality.op3_quality,
    "op4_packing": packing.op4_packing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_warc": warc.op6_warc,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_piece_codec": piece_codec.op8_piece_codec,
    "op9_language_id": language_id.op9_language_id,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_jaccard_join": jaccard_join.op11_jaccard_join,
    "op12_divergence": divergence.op12_divergence,
    "op13_centroids": centroids.op13_centroids,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_near_dedup": f"SELECT *, doc_id = component_id AS kept FROM ({near_dedup.links_sql(3, 85)})",
    "op11_jaccard_join": near_dedup.links_sql(5, 80),
    "op12_divergence": divergence.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
