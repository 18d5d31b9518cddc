"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from reefline.llm import q_chat, q_decontaminate, q_html, q_licenses, q_lines, q_lm, q_manifest, q_packing, q_quality, q_repair, q_rules, q_simhash, q_toxicity

_MODULES = (q_chat, q_rules, q_decontaminate, q_simhash, q_packing, q_toxicity, q_quality, q_html, q_lm, q_lines, q_licenses, q_manifest, q_repair)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
