"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from sonarium.llm import bpe, chat, exact_dedup, fill_middle, language_id, line_dedup, mixing, ngram_join, quality, substring_dedup, suffix_dedup, topk_search, whitening

QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup.op1_exact_dedup, language_id.op2_language_id, mixing.op3_mixing, quality.op4_quality, substring_dedup.op5_substring_dedup,
        line_dedup.op6_line_dedup, topk_search.op7_topk_search, bpe.op8_bpe, ngram_join.op9_ngram_join, chat.op10_chat_format,
        suffix_dedup.op11_suffix_dedup, whitening.op12_whitening, fill_middle.op13_fill_middle,
    )
}

#: Without SQL: trained models (2, 4, 10), SimHash with Spark's hash function (6), merges by rank (8), eigenvectors (12).
SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL, "op3_mixing": mixing.OP3_SQL, "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op7_topk_search": topk_search.OP7_SQL, "op9_ngram_join": ngram_join.OP9_SQL,
    "op11_suffix_dedup": suffix_dedup.OP11_SQL, "op13_fill_middle": fill_middle.OP13_SQL,
}
