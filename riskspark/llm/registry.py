"""Queries of the operators in this folder. SQL is given where DuckDB can express the rows."""

from __future__ import annotations

from riskspark.llm import audio_fingerprint, byte_bpe, collocations, context_tree, fingerprint, jaccard_join, language_id, oracles, packing, quality, ranked_search, secret_scan, substring_dedup, url_filter


def queries():
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_secret_ledger": secret_scan.secrets_query,
        "op2_harmonic_packing": packing.packing_query,
        "op3_jaccard_join": jaccard_join.jaccard_query,
        "op4_compression_language": language_id.language_query,
        "op5_context_tree": context_tree.scores_query,
        "op6_bottom_k": fingerprint.fingerprint_query,
        "op7_anchor_dedup": substring_dedup.substring_query,
        "op8_distinct_word_bpe": byte_bpe.bpe_query,
        "op9_url_filter": url_filter.url_query,
        "op10_chroma_fingerprint": audio_fingerprint.recordings_query,
        "op11_bayes_vectors": quality.quality_query,
        "op12_treap_search": ranked_search.search_query,
        "op13_summary_collocations": collocations.collocations_query,
    }


def oracle_sql():
    """Queries without SQL are tested against brute force in tests/llm."""
    return {
        "op1_secret_ledger": oracles.secrets(),
        "op3_jaccard_join": oracles.components(),
        "op7_anchor_dedup": oracles.repeats(),
        "op12_treap_search": oracles.ranked(),
        "op13_summary_collocations": oracles.phrases(),
    }
