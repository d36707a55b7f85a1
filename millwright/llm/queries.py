"""The corpus queries, by name, and their DuckDB equivalents where SQL can express them."""

from millwright.llm import decontaminate, exact_dedup, hilbert, htmltext, langid, packing, paragraphs, periodic, simhash, suffix_dedup, toxicity, turns, urlfilter

_MODULES = (decontaminate, exact_dedup, hilbert, htmltext, langid, packing, paragraphs, periodic, simhash, suffix_dedup, toxicity, turns, urlfilter)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
