"""A property-graph query engine on PySpark DataFrames."""

from graphloom.api import Graph
from graphloom.plans.ast import CypherError
from graphloom.sources.schema import GraphSchema, load_schemas

__all__ = ["CypherError", "Graph", "GraphSchema", "load_schemas"]
