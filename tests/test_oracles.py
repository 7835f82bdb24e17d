"""Registered queries against their SQL on the smallest tables."""

import importlib
import pkgutil

import pytest

import __spark_entry__ as entry
from maskwell.registry import QUERIES, SQL
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    assert difference(spark, name, SF, QUERIES, SQL) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"req", "first_match", "n_matches"}
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_nothing_outside_llm_imports_it():
    import maskwell

    for module in pkgutil.walk_packages(maskwell.__path__, "maskwell."):
        if not module.name.startswith("maskwell.llm"):
            source = importlib.util.find_spec(module.name).origin
            assert "maskwell.llm" not in open(source).read() and "from .llm" not in open(source).read(), module.name
