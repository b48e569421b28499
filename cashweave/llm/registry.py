"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from cashweave.llm import (
    decontaminate,
    fingerprints,
    hard_negatives,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    prefix_trie,
    quality,
    secret_scan,
    suffix_dedup,
    toxicity,
)

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality": quality.op4_quality,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_packing": packing.op6_packing,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_mixing": mixing.op13_mixing,
}
ORACLE = {
    "op1_ngram_join": ngram_join.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_mixing": mixing.OP13_SQL,
}
