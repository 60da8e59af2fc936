"""The registered queries of the lattice engine and their SQL."""

from __future__ import annotations

from . import files, layers, places, reports, surface, thermal, walls

QUERIES: dict = surface.QUERIES | thermal.QUERIES | walls.QUERIES | reports.QUERIES | layers.QUERIES | files.QUERIES | places.QUERIES
ORACLE: dict[str, str] = surface.ORACLE | thermal.ORACLE | walls.ORACLE | reports.ORACLE | layers.ORACLE | files.ORACLE | places.ORACLE
