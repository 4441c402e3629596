"""Queries over the star-schema tables seen as graphs, with SQL equivalents."""
