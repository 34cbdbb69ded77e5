"""All queries over tables by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import composite_oracles, composites, definitions, matching, oracles, provided, queries, reports

QUERIES = queries.QUERIES | composites.QUERIES | matching.QUERIES | definitions.QUERIES | provided.QUERIES | reports.QUERIES
ORACLES = oracles.ORACLES | composite_oracles.ORACLES | matching.ORACLES | definitions.ORACLES | provided.ORACLES | reports.ORACLES
