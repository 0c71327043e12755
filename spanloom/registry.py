"""All registered queries and their SQL, by name."""

from __future__ import annotations

from .plans import data, detection, scoring, streams

QUERIES: dict = detection.QUERIES | scoring.QUERIES | data.QUERIES | streams.QUERIES
ORACLE_SQL: dict[str, str] = detection.ORACLE_SQL | scoring.ORACLE_SQL | data.ORACLE_SQL | streams.ORACLE_SQL
