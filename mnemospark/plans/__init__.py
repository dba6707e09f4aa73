"""Registered queries: Spark builders and their DuckDB oracle SQL."""

from .registry import OPERATORS, ORACLE, QUERIES


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    from . import q_ingest, q_misc, q_search, q_state, q_store, q_stream, q_text  # noqa: F401


__all__ = ["OPERATORS", "ORACLE", "QUERIES", "load_all"]
