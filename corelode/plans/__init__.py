"""Registered queries over the driver's tables, and the SQL they must agree with."""

from __future__ import annotations

from . import curves, depth, petrophysics, records, sources, tables, zones

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (petrophysics, zones, depth, curves, tables, sources, records):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
