"""Queries over the driver tables, by name, and their DuckDB SQL."""

from __future__ import annotations

from . import q_baselines, q_detectors, q_evaluators, q_fleet, q_functions, q_matrix, q_more

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (q_functions, q_baselines, q_detectors, q_evaluators, q_fleet, q_matrix, q_more):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
FLAGSHIP = "mixture_fleet_ebh"
