"""All queries of the engine."""

from larkspur.catalog import blocks, chats, contents, documents, rules, stored, streams, tables, views  # noqa: F401  they register their queries
from larkspur.catalog.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
