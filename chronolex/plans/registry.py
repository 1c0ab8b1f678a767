"""All queries by name, and their SQL."""

from __future__ import annotations

from chronolex.plans import extras, features, files, learn, texts, words  # noqa: F401
from chronolex.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
