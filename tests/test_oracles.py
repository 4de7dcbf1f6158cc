"""Every registered query that has SQL gives the SQL's rows."""

from __future__ import annotations

import pytest
from harness import duck_table, spark_table

from siloforge.plans import catalog, catalog_more, catalog_ranking

assert catalog_ranking and catalog_more


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(name, spark, duck, sf_dir):
    got, want = spark_table(catalog.QUERIES[name](spark, sf_dir)), duck_table(duck, catalog.ORACLES[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
