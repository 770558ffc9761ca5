"""All queries of the library, and the SQL each is checked against."""

from __future__ import annotations

from . import applications, community, complexity, further, graphs, indices, readings, similarity

PARTS = (complexity, indices, similarity, graphs, community, applications, readings, further)
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in PARTS for k, v in p.SQL.items()}
