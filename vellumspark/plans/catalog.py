"""Registry of the library's own queries and their SQL."""

from __future__ import annotations

from . import q_calendar, q_derived, q_docs, q_extract, q_formats, q_links, q_pieces, q_relate, q_scalar, q_search, q_stream, q_versions, q_watch

MODULES = (q_search, q_relate, q_calendar, q_derived, q_docs, q_extract, q_formats, q_links, q_pieces, q_scalar, q_stream, q_versions, q_watch)


def queries() -> dict:
    return {k: f for m in MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, (_, q) in m.QUERIES.items() if q}


def cases() -> dict:
    """Rows of our own, as (query, SQL), for tests."""
    return {k: v for m in MODULES for k, v in getattr(m, "CASES", {}).items()}
