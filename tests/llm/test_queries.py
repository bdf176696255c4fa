from __future__ import annotations

import os

import pytest
from conftest import DATA

import __spark_entry__ as entry
from vellum.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() >= 0


def test_core_does_not_import_llm():
    for root, _, files in os.walk(os.path.join(os.path.dirname(entry.__file__), "vellum")):
        if "llm" not in root.split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    assert "vellum.llm" not in open(os.path.join(root, f)).read()
