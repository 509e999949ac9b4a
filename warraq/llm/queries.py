"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from warraq.llm import bpe, chat_format, decontaminate, digest_index, filter_audit, hilbert_shards, near_dups, pairwise_quality, quality_rules, repeated_spans, site_text, spelling, token_planes

QUERIES = {
    "op1_chat_formatting": chat_format.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_token_planes": token_planes.op3,
    "op4_hilbert_sharding": hilbert_shards.op4,
    "op5_quality_rules": quality_rules.op5,
    "op6_decontamination": decontaminate.op6,
    "op7_pairwise_quality": pairwise_quality.op7,
    "op8_repeated_spans": repeated_spans.op8,
    "op9_html_extraction": site_text.op9,
    "op10_minhash_near_dedup": near_dups.op10,
    "op11_exact_dedup": digest_index.op11,
    "op12_spelling_variants": spelling.op12,
    "op13_filter_audit": filter_audit.op13,
}

ORACLES = {
    "op1_chat_formatting": chat_format.OP1_SQL,
    "op4_hilbert_sharding": hilbert_shards.OP4_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
    "op10_minhash_near_dedup": near_dups.OP10_SQL,
    "op11_exact_dedup": digest_index.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
