"""The contract of the entry module, with and without the llm subpackage."""

import importlib.util

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("engine.llm") else real(n, *a))
    assert {"p1_found", "p2_found", "p4_found", "p6_found"} <= set(entry.queries()) and "p3_found" not in entry.queries()
