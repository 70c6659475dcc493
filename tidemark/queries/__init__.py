"""All queries of the engine's own operators."""

from tidemark.queries import changes, columns, dimensions, joining, scans, syncing  # noqa: F401
from tidemark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
