"""Registered queries of the subpackage, and the SQL that DuckDB must answer alike where SQL can express them."""

from __future__ import annotations

from roadloom.llm import op3_query, op4_query, op6_query, op9_query
from roadloom.llm.op1_query import op1_hash_tree
from roadloom.llm.op10_query import op10_compact_windows
from roadloom.llm.op2_query import op2_bit_planes
from roadloom.llm.op3_query import op3_wu_manber
from roadloom.llm.op4_query import op4_adaptive_quality
from roadloom.llm.op5_query import op5_chat_windows
from roadloom.llm.op6_query import op6_bloom_urls
from roadloom.llm.op7_query import op7_byte_bpe
from roadloom.llm.op8_query import op8_katz_backoff
from roadloom.llm.op9_query import op9_jaccard_join

QUERIES = {f.__name__: f for f in (op1_hash_tree, op2_bit_planes, op3_wu_manber, op4_adaptive_quality, op5_chat_windows, op6_bloom_urls, op7_byte_bpe, op8_katz_backoff, op9_jaccard_join, op10_compact_windows)}

ORACLES: dict[str, str] = {
    "op3_wu_manber": op3_query.ORACLE,
    "op4_adaptive_quality": op4_query.ORACLE,
    "op6_bloom_urls": op6_query.ORACLE,
    "op9_jaccard_join": op9_query.ORACLE,
}
