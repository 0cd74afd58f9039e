"""All registered queries of the page-analytics engine, and their SQL."""

from __future__ import annotations

from pagelattice.plans import evaluation_queries, graph_queries, page_queries, propagation_queries

MODULES = (page_queries, graph_queries, evaluation_queries, propagation_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
