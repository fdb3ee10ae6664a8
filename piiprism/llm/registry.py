"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from . import additive, chat, html, impact, jaccard, kdtree, minhash, mixing, pii, repair, toxicity, trie, viterbi

QUERIES = {
    "op1_pii_tagger": pii.op1,
    "op2_repair_tokens": repair.op2,
    "op3_chat_formatting": chat.op3,
    "op4_html_consensus": html.op4,
    "op5_sentencepiece": viterbi.op5,
    "op6_toxicity": toxicity.op6,
    "op7_minhash_near_dedup": minhash.op7,
    "op8_exact_top_k": kdtree.op8,
    "op9_approximate_neighbours": additive.op9,
    "op10_source_mixing": mixing.op10,
    "op11_jaccard_join": jaccard.op11,
    "op12_impact_search": impact.op12,
    "op13_prefix_trie": trie.op13,
}

ORACLE_SQL = {
    "op3_chat_formatting": chat.OP3_SQL,
    "op7_minhash_near_dedup": minhash.OP7_SQL,
    "op8_exact_top_k": kdtree.OP8_SQL,
    "op11_jaccard_join": jaccard.OP11_SQL,
    "op12_impact_search": impact.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
