"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe, conversations, decontaminate, exact_dedup, hard_negatives, html_text, jaccard_join, language_id, near_dedup, passages, secrets, toxicity, url_filter


def queries() -> dict:
    import corpus_pipeline

    out = [url_filter.op1_url_filter, bpe.op2_bpe, exact_dedup.op3_exact_dedup, passages.op4_substring_dedup, toxicity.op5_toxicity, html_text.op6_html_extraction, language_id.op7_language_id, decontaminate.op8_decontamination, secrets.op9_secret_scan, near_dedup.op10_minhash_near_dedup, jaccard_join.op11_jaccard_join, hard_negatives.op12_hard_negatives, conversations.op13_conversation_repair]
    return {f.__name__: f for f in out} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.SQL, "op3_exact_dedup": exact_dedup.SQL, "op8_decontamination": decontaminate.SQL, "op12_hard_negatives": hard_negatives.SQL}
