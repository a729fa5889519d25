"""All queries of the core, and their SQL."""

from __future__ import annotations

from noteweave.plans import graph_queries, problems, reading_queries, structure_queries, text_queries

PARTS = (problems, text_queries, graph_queries, structure_queries, reading_queries)
QUERIES = {name: q for part in PARTS for name, q in part.QUERIES.items()}
ORACLE = {name: q for part in PARTS for name, q in part.ORACLE.items()}
