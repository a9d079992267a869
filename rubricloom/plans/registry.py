"""All queries of the core library and their SQL."""

from __future__ import annotations

from rubricloom.plans import checks, corpora, envelopes, pages, records, scoring

_MODULES = [records, checks, pages, envelopes, scoring, corpora]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
