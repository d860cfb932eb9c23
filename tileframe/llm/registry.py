"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import backoff, jaccard_join, kneser_ney, langid, metric_tree, mixing, pieces, quality, secrets, toxicity

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_backoff_score": backoff.op2_backoff_score,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language_id": langid.op6_language_id,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_top_scores": metric_tree.op8_top_scores,
    "op9_quality_perplexity": kneser_ney.op9_quality_perplexity,
    "op10_piece_codec": pieces.op10_piece_codec,
}

ORACLE_SQL = {
    "op2_backoff_score": backoff.OP2_SQL,
    "op3_source_mix": mixing.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op8_top_scores": metric_tree.OP8_SQL,
}
