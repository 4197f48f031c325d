"""Registered queries of the text operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from echolark.llm import byte_bpe, collocations, exact_dedup, mixing, near_dedup, pii_surrogates, prefix_trie, quality_rules, secret_scan, substring_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_suffix_dedup": substring_dedup.op4_suffix_dedup,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_pii_surrogates": pii_surrogates.op8_pii_surrogates,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_source_mixing": mixing.op10_source_mixing,
    "op11_collocations": collocations.op11_collocations,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {"op6_exact_dedup": exact_dedup.OP6_SQL, "op9_url_filter": url_filter.OP9_SQL, "op11_collocations": collocations.OP11_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
