"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, html_text, licences, mixing, neardup, quality, substring, topk, viterbi

_QUERIES = [
    topk.op1_exact_top_k,
    substring.op2_substring_dedup,
    licences.op3_license_scan,
    viterbi.op4_unigram_token_counts,
    quality.op5_quality_rules,
    html_text.op6_html_extraction,
    ann.op7_learned_partitions_ann,
    bpe.op8_byte_level_bpe,
    mixing.op9_entropy_mixing,
    neardup.op10_minhash_near_dedup,
]
_ORACLES = {"op1_exact_top_k": topk.OP1_SQL, "op3_license_scan": licences.OP3_SQL}


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
