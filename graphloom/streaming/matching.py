"""Stateless matching over streams.

A graph's table may be a streaming frame; a query that only filters, projects
and joins it with static tables compiles to a streaming frame as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.api import Graph
from graphloom.plans.ast import CypherError


def stream_query(graph: Graph, text: str, params: dict | None = None) -> DataFrame:
    """The query as a streaming frame, for writeStream."""
    df = graph.cypher(text, params)
    if not df.isStreaming:
        raise CypherError("no table of this query is a stream")
    return df
