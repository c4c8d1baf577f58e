"""Registered queries: each operator over the given tables, with DuckDB SQL where SQL can express it."""

from . import chunks, citations, clusters, concepts, edges, graphs, search, sources, streams, usage  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
