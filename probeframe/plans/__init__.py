"""Fixtures, queries and their SQL."""

from . import selection_queries, tensor_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "selection_queries", "tensor_queries"]
