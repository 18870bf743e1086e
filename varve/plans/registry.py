"""All core queries by name, and the SQL of those it can express."""

from __future__ import annotations

from varve.plans import retail, single_cell, vectors

QUERIES = retail.QUERIES | single_cell.QUERIES | vectors.QUERIES
ORACLES = retail.ORACLES | single_cell.ORACLES | vectors.ORACLES
