"""The queries of this subpackage, by name."""

from __future__ import annotations

import corpus_pipeline
from passagework.llm import queries_clean, queries_near, queries_score, queries_tokens, queries_train

QUERIES = {
    "op1_url_filter": queries_clean.op1_url_filter,
    "op2_main_text": queries_clean.op2_main_text,
    "op3_warc": queries_clean.op3_warc,
    "op4_bpe_round_trip": queries_tokens.op4_bpe_round_trip,
    "op5_quality": queries_score.op5_quality,
    "op6_decontaminate": queries_clean.op6_decontaminate,
    "op7_fingerprints": queries_near.op7_fingerprints,
    "op8_toxicity": queries_score.op8_toxicity,
    "op9_near_duplicates": queries_near.op9_near_duplicates,
    "op10_token_shards": queries_tokens.op10_token_shards,
    "op11_host_rules": queries_train.op11_host_rules,
    "op12_fill_in_middle": queries_train.op12_fill_in_middle,
    "op13_hard_negatives": queries_train.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_warc": queries_clean.OP3_SQL,
    "op6_decontaminate": queries_clean.OP6_SQL,
    "op9_near_duplicates": queries_near.OP9_SQL,
    "op11_host_rules": queries_train.OP11_SQL,
    "op12_fill_in_middle": queries_train.OP12_SQL,
    "op13_hard_negatives": queries_train.OP13_SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
