"""Queries and oracle SQL of this folder."""

from thicket.llm import bpe, chat, context_tree, hilbert_shards, jaccard_join, kmeans, language_id, licenses, merkle, mixing, quality_rules, substring_dedup, topk

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_ngram_jaccard": jaccard_join.op4_ngram_jaccard,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_hilbert_sharding": hilbert_shards.op7_hilbert_sharding,
    "op8_language_id": language_id.op8_language_id,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_lm_scoring": context_tree.op12_lm_scoring,
    "op13_centroid_clustering": kmeans.op13_centroid_clustering,
}
ORACLES = {
    "op5_exact_topk": topk.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op10_license_scan": licenses.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_centroid_clustering": kmeans.ORACLE,
}
