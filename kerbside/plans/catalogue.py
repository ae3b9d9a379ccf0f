"""All queries over the fixture tables, with their SQL twins."""

from __future__ import annotations

from kerbside.plans import analysis_queries, dataset_queries, ranging_queries
from kerbside.plans.fixtures import Query

_BOOKS = (ranging_queries.book, dataset_queries.book, analysis_queries.book)
QUERIES: dict[str, Query] = {name: query for book in _BOOKS for name, query in book.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for book in _BOOKS for name, sql in book.sql.items()}
