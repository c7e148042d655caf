"""Every registered query of the engine with its DuckDB equivalent."""

from . import block_queries, format_queries, join_queries, kernel_queries, lookahead_queries, report_queries, sequence_queries, verdict_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
