"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from ledgerloom.llm import bpe, chat_format, collocations, decontaminate, embed_dedup, lm_score, merkle, quality, simhash, suffix_dedup, token_counts, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_lm_score": lm_score.op3_lm_score,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_embedding_dedup": embed_dedup.op5_embedding_dedup,
        "op6_bpe": bpe.op6_bpe,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_simhash": simhash.op8_simhash,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_quality": quality.op10_quality,
        "op11_collocations": collocations.op11_collocations,
        "op12_merkle": merkle.op12_merkle,
        "op13_token_counts": token_counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.ORACLE,
        "op5_embedding_dedup": embed_dedup.ORACLE,
        "op9_url_filter": url_filter.ORACLE,
        "op11_collocations": collocations.ORACLE,
        "op12_merkle": merkle.ORACLE,
    }
