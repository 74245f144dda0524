"""Registry of named queries: name -> Spark function, and name -> oracle SQL where SQL can express it."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
