"""All registered queries of the library and the SQL each is checked against."""

from __future__ import annotations

from reefline.plans import q_depth, q_events, q_reports, q_stored, q_stream, q_tracks


def _modules():
    return [q_depth, q_events, q_tracks, q_reports, q_stream, q_stored]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
