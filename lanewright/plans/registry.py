"""Every query over the driver tables, and the DuckDB SQL with the same result."""

from __future__ import annotations

from lanewright.plans import associations, polylines, roadnet, vehicles

_MODULES = (polylines, associations, vehicles, roadnet)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
