"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_llm_subpackage():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "lexloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+.*\bllm\b", p.read_text(), re.M), p
