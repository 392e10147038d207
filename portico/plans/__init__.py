"""Registered queries: importing a module registers its queries."""

from . import assembly_queries, box_queries, code_queries, data_queries, format_queries, fusion_queries, more_queries, pass_queries, sink_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "assembly_queries", "box_queries", "code_queries", "data_queries", "format_queries", "fusion_queries", "more_queries", "pass_queries", "sink_queries"]
