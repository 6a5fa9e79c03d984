"""Names of the training-data queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, mixing, near_dedup, packing, periodic_runs, secret_scan, substring_dedup, token_counts, topk, toxicity, whitening


def queries():
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_bpe": bpe.op2_bpe,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_toxicity": toxicity.op5_toxicity,
        "toxicity_group_gaps": toxicity.toxicity_group_gaps,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_topk": topk.op7_topk,
        "op8_packing": packing.op8_packing,
        "op9_chat": chat.op9_chat,
        "op10_mixing": mixing.op10_mixing,
        "op11_substring_dedup": substring_dedup.op11_substring_dedup,
        "op12_whitening": whitening.op12_whitening,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql():
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op7_topk": topk.SQL,
        "op10_mixing": mixing.sql(),
    }
