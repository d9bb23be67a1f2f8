"""Queries of the engine over tables derived from the driver's, with their SQL oracles."""

from . import changes, lookups  # noqa: F401  (they register their queries)
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
