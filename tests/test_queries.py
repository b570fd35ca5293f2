"""Every query of the main catalogue against its SQL, or that it runs where SQL can't express it."""

from __future__ import annotations

import os

import pytest

from pagewright.plans import catalog

from .compare import differing

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() > 0
    else:
        assert differing(df, SF, sql) == ""
