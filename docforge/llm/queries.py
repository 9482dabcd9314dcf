"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from docforge.llm import bpe, centroids, chat_format, decontaminate, language_id, pii, prefix_trie, rule_quality, simhash_dedup, token_counts, token_files, url_filter, vector_dedup

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_chat_format": chat_format.query,
    "op3_token_files": token_files.query,
    "op4_simhash_dedup": simhash_dedup.query,
    "op5_token_counts": token_counts.query,
    "op6_vector_dedup": vector_dedup.query,
    "op7_bpe": bpe.query,
    "op8_url_filter": url_filter.query,
    "op9_language_id": language_id.query,
    "op10_pii": pii.query,
    "op11_centroids": centroids.query,
    "op12_rule_quality": rule_quality.query,
    "op13_prefix_trie": prefix_trie.query,
}

SQL = {
    "op2_chat_format": chat_format.SQL,
    "op6_vector_dedup": vector_dedup.SQL,
    "op8_url_filter": url_filter.SQL,
    "op11_centroids": centroids.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
