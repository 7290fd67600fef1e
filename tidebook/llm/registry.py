"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import q_automaton, q_chat, q_dedup, q_media, q_mixing, q_negatives, q_order, q_packing, q_periodic, q_perplexity, q_rules, q_toxicity, q_urls

MODULES = [q_order, q_urls, q_mixing, q_perplexity, q_chat, q_media, q_packing, q_dedup, q_rules, q_toxicity, q_negatives, q_automaton, q_periodic]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
