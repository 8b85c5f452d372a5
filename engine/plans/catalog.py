"""The general library's queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from engine.operators import changes, flows, index, lines, periods, regions, sessions

QUERIES = {
    "p1_found": periods.found,
    "p2_found": changes.found,
    "p2_writes": changes.writes,
    "p2_settings": changes.settings,
    "p2_columns": changes.columns,
    "p4_found": lines.found,
    "p4_valid": lines.valid,
    "p6_found": sessions.found,
    "p6_durations": sessions.durations,
    **flows.QUERIES,
    **index.QUERIES,
    **regions.QUERIES,
}
SQL = {"p1_found": periods.SQL, **flows.SQL, **index.SQL, **regions.SQL}
