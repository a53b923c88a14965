"""All queries of the core and the SQL they are checked against."""

from __future__ import annotations

from termforest.plans import graph_queries, hierarchy_queries, kernel_queries, read_queries, relation_queries, term_queries

FLAGSHIP = "tfidf_top_terms"
_MODULES = (term_queries, graph_queries, kernel_queries, relation_queries, read_queries, hierarchy_queries)


def queries() -> dict:
    return {name: q for module in _MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
