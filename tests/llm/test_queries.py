"""Every query of the subpackage that SQL can express, against its SQL."""

from __future__ import annotations

import os

import pytest

from pagewright.llm import queries

from ..compare import differing

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert differing(queries.QUERIES[name](spark, SF), SF, queries.ORACLE_SQL[name]) == ""
