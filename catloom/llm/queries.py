"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from catloom.llm import bottomk, byte_bpe, embed_graph, exact_dedup, hash_tree, langid, merkle, mixing, orc_tokens, quality, secret_scan, token_counts, treap_search

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_pruned_graph_near_dedup": embed_graph.op2_pruned_graph_near_dedup,
    "op3_bottomk_near_dedup": bottomk.op3_bottomk_near_dedup,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_compression_quality": quality.op5_compression_quality,
    "op6_hash_tree_shards": hash_tree.op6_hash_tree_shards,
    "op7_naive_bayes_langid": langid.op7_naive_bayes_langid,
    "op8_orc_tokens": orc_tokens.op8_orc_tokens,
    "op9_pfair_mixing": mixing.op9_pfair_mixing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_treap_search": treap_search.op12_treap_search,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {"op10_exact_dedup": exact_dedup.OP10_SQL, "op12_treap_search": treap_search.OP12_SQL, "op13_merkle_manifest": merkle.OP13_SQL}
