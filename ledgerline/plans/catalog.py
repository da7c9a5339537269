"""All registered queries; importing a module registers its queries."""

from __future__ import annotations

from . import aggregates, domain, filings, matching, people, profiles, relational, relations, structure  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
