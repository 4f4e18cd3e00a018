"""The queries of this package, for the driver's entry point."""

from __future__ import annotations

from . import bpe, chat_tree, decontaminate, near_join, repeats, token_files, topk, toxicity, url_rules, word_pieces

QUERIES = {
    "op1_chat_format": chat_tree.op1_chat_format,
    "op2_near_join": near_join.op2_near_join,
    "op3_bpe": bpe.op3_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_topk": topk.op5_topk,
    "op6_token_counts": word_pieces.op6_token_counts,
    "op7_token_files": token_files.op7_token_files,
    "op8_repeats": repeats.op8_repeats,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES = {"op1_chat_format": chat_tree.OP1_SQL, "op5_topk": topk.OP5_SQL}
