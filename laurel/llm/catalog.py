"""The subpackage's queries and their SQL forms."""

from __future__ import annotations

from laurel.llm import chat, decontamination, jaccard, merkle, mixing, near_vectors, prefix_trie, quality, quality_rules, secrets, sql_forms, substrings, token_files, toxicity

RUNS = {
    "op1_mixing": mixing.op1_mixing,
    "op2_chat": chat.op2_chat,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_near_vectors": near_vectors.op5_near_vectors,
    "op6_quality": quality.op6_quality,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_secrets": secrets.op8_secrets,
    "op9_token_files": token_files.op9_token_files,
    "op10_substrings": substrings.op10_substrings,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_merkle": merkle.op13_merkle,
}
SQL = {
    "op1_mixing": mixing.ORACLE,
    "op2_chat": chat.ORACLE,
    "op4_decontamination": decontamination.ORACLE,
    "op5_near_vectors": sql_forms.NEAR_VECTORS,
    "op7_jaccard": sql_forms.JACCARD,
    "op8_secrets": sql_forms.SECRETS,
    "op10_substrings": sql_forms.SUBSTRINGS,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_quality_rules": quality_rules.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
