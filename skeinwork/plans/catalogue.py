"""Registry of the library's queries and their DuckDB oracles."""

from __future__ import annotations

from skeinwork.plans import commits, crawl, directory, events, identifiers, jobs, records, repositories, resync, schemas, sources, stream, typed  # noqa: F401  they register themselves
from skeinwork.plans.registry import ORACLES, QUERIES

FLAGSHIP = "flagship_op_summary"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
