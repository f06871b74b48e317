"""All registered queries."""

from repotide.catalog import (
    extract_queries, freshness_queries, graph_queries, operations_queries, path_queries, source_queries, stream_queries, text_queries)  # noqa: F401
from repotide.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
