"""Queries over the provided tables, one for each corpus operator."""

from __future__ import annotations

from aeroflow.llm.byte_bpe import op2_byte_bpe
from aeroflow.llm.html_text import op6_main_text
from aeroflow.llm.lang_id import op1_language_id
from aeroflow.llm.mixing import OP3_SQL, op3_mix_sources
from aeroflow.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from aeroflow.llm.quality_model import op9_quality_model
from aeroflow.llm.quality_rules import OP8_SQL, op8_quality_rules
from aeroflow.llm.simhash import op4_simhash
from aeroflow.llm.source_audit import OP13_SQL, op13_source_divergence
from aeroflow.llm.substring_dedup import op5_substring_dedup
from aeroflow.llm.suffix_dedup import op12_suffix_dedup
from aeroflow.llm.token_records import op7_token_records
from aeroflow.llm.topk import OP10_SQL, op10_cover_tree_topk

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mix_sources": op3_mix_sources,
    "op4_simhash": op4_simhash,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_main_text": op6_main_text,
    "op7_token_records": op7_token_records,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_model": op9_quality_model,
    "op10_cover_tree_topk": op10_cover_tree_topk,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL = {"op3_mix_sources": OP3_SQL, "op8_quality_rules": OP8_SQL, "op10_cover_tree_topk": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_source_divergence": OP13_SQL}
