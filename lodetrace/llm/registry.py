"""Queries and oracles of the training-data operators, by registered name."""

from __future__ import annotations

from lodetrace.llm import conversation_repair, embedding_dedup, exact_dedup, filter_audit, html_text, line_dedup, minhash, mixing, pieces, quality, resharding, topk_search, warc


def queries():
    return {
        "op1_mix_sources": mixing.op1_mix,
        "op2_near_dedup": minhash.op2_near_dedup,
        "op3_html_text": html_text.op3_html_text,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
        "op7_quality_classifier": quality.op7_quality,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_warc": warc.op9_warc,
        "op10_reshard": resharding.op10_reshard,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_topk_search": topk_search.op13_topk_search,
    }


def oracle_sql():
    return {
        "op1_mix_sources": mixing.OP1_SQL,
        "op2_near_dedup": minhash.OP2_SQL,
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op5_line_dedup": line_dedup.OP5_SQL,
        "op6_embedding_dedup": embedding_dedup.OP6_SQL,
        "op9_warc": warc.OP9_SQL,
        "op11_conversation_repair": conversation_repair.OP11_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_topk_search": topk_search.OP13_SQL,
    }
