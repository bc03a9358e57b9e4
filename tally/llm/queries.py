"""The registered queries of the subpackage, and SQL for those that have any."""

from __future__ import annotations

from tally.llm import (conversation_repair, conversation_trie, fingerprints, kneser_ney, mixing, nearest, sentencepiece,
                       sharding, simhash, suffix_array, token_count, toxicity, url_filter)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_sentencepiece": sentencepiece.op2_sentencepiece,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_sharding": sharding.op6_sharding,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_token_counts": token_count.op8_token_counts,
    "op9_nearest": nearest.op9_nearest,
    "op10_lm_scoring": kneser_ney.op10_lm_scoring,
    "op11_suffix_dedup": suffix_array.op11_suffix_dedup,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op7_url_filter": url_filter.ORACLE_SQL,
    "op11_suffix_dedup": suffix_array.ORACLE_SQL,
    "op12_conversation_trie": conversation_trie.ORACLE_SQL,
    "op13_conversation_repair": conversation_repair.ORACLE_SQL,
}
