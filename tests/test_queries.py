"""Every registered query with a SQL twin gives the twin's rows."""

import pytest
from oracle import both

import __spark_entry__ as entry
from attest.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    ours, theirs = both(spark, registry.QUERIES[name], registry.ORACLES[name], SMALL)
    assert ours == theirs


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[0] == "doc_id" and out.count() == 50


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
