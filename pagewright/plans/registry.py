"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pagewright.plans import change_queries, relational, workspace_queries

PARTS = (workspace_queries, change_queries, relational)

QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
