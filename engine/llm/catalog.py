"""The subpackage's queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from engine.llm import distinct, frequent, leaks, packing, seen, subjects

QUERIES = {
    "p3_found": seen.found,
    "p3_rate": seen.rate,
    "p5_found": frequent.found,
    "p5_counted": frequent.counted,
    "p7_found": distinct.found,
    "p7_estimates": distinct.estimates,
    "p7_pairs": distinct.pairs,
    "p8_containers": packing.containers,
    "p8_fills": packing.fills,
    "p8_summary": packing.summary,
    "p9_found": leaks.found,
    "p9_affected": leaks.affected,
    "p10_found": subjects.found,
    "p10_composition": subjects.composition,
}
SQL = {"p5_found": frequent.SQL, "p7_found": distinct.SQL}
