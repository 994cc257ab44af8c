"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from tessitura.llm import compression, conversations, decontam, lm, mixing, neardup, packing, phrases, privacy, rules, sharding, substrings

QUERIES = {
    "op1_pack_binary": packing.op1_pack_binary,
    "op2_kd_shards": sharding.op2_kd_shards,
    "op3_zstd_language": compression.op3_zstd_language,
    "op4_bwt_merge": substrings.op4_bwt_merge,
    "op5_zstd_quality": compression.op5_zstd_quality,
    "op6_rule_ledger": rules.op6_rule_ledger,
    "op7_hyperminhash": neardup.op7_hyperminhash,
    "op8_bilstm_crf": privacy.op8_bilstm_crf,
    "op9_minhash_containment": decontam.op9_minhash_containment,
    "op10_log_bilinear": lm.op10_log_bilinear,
    "op11_systematic_mix": mixing.op11_systematic_mix,
    "op12_fold_repair": conversations.op12_fold_repair,
    "op13_trie_phrases": phrases.op13_trie_phrases,
}
ORACLES: dict[str, str] = {
    "op4_bwt_merge": substrings.ORACLE,
    "op6_rule_ledger": rules.ORACLE,
    "op7_hyperminhash": neardup.ORACLE,
    "op9_minhash_containment": decontam.ORACLE,
    "op11_systematic_mix": mixing.ORACLE,
    "op12_fold_repair": conversations.ORACLE,
    "op13_trie_phrases": phrases.ORACLE,
}
