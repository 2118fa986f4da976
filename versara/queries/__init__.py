"""Registered queries over the driver's tables, each with its SQL."""

from versara.queries import checking, coordinates, searching

QUERIES = searching.QUERIES | coordinates.QUERIES | checking.QUERIES
ORACLE_SQL = searching.ORACLE_SQL | coordinates.ORACLE_SQL | checking.ORACLE_SQL
