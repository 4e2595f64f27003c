"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from . import chat, chat_repair, decontaminate, language, license_scan, line_crf, merkle, ngram_join, packing, pseudonyms, quality_rules, secret_scan, toxicity

QUERIES = {
    "op1_byte_cnn_language": language.query,
    "op2_snapshot_collapse": chat.query,
    "op3_risk_controlled_rules": quality_rules.query,
    "op4_cost_balanced_packing": packing.query,
    "op5_prefix_tree_join": ngram_join.query,
    "op6_line_crf_quality": line_crf.query,
    "op7_entropy_secrets": secret_scan.query,
    "op8_feistel_pseudonyms": pseudonyms.query,
    "op9_nnpu_toxicity": toxicity.query,
    "op10_latent_decontamination": decontaminate.query,
    "op11_license_signatures": license_scan.query,
    "op12_viterbi_repair": chat_repair.query,
    "op13_merkle_manifest": merkle.query,
}
ORACLE: dict[str, str] = {
    "op2_snapshot_collapse": chat.SQL,
    "op3_risk_controlled_rules": quality_rules.sql(),
    "op5_prefix_tree_join": ngram_join.SQL,
    "op7_entropy_secrets": secret_scan.sql(),
    "op11_license_signatures": license_scan.sql(),
    "op12_viterbi_repair": chat_repair.sql(),
    "op13_merkle_manifest": merkle.sql(),
}
