"""Queries of the training-data operators, by name, and their SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, hard_negatives, language_id, main_text, near_dedup, pieces, pitman_yor, prefix_trie, quality_rules, record_files, sql, suffix_dedup, top_k, warc_revisits

QUERIES = {
    "op1_warc_revisits": warc_revisits.op1_warc_revisits,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_html_main_text": main_text.op3_html_main_text,
    "op4_language_id": language_id.op4_language_id,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_pitman_yor": pitman_yor.op6_pitman_yor,
    "op7_record_files": record_files.op7_record_files,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_exact_top_k": top_k.op12_exact_top_k,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
SQL: dict[str, str] = {"op2_suffix_dedup": sql.OP2_SQL, "op1_warc_revisits": warc_revisits.OP1_SQL, "op9_near_dedup": near_dedup.OP9_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op12_exact_top_k": top_k.OP12_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
