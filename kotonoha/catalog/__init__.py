"""Registered queries, one module per operator family."""

from kotonoha.catalog.registry import ORACLE, QUERIES  # noqa: F401
from kotonoha.catalog import (  # noqa: F401,E402
    index_queries, querylog_queries, ranking_queries, reshape_queries, retrieval_queries,
    segment_queries, structure_queries, suggest_queries, text_queries)
