"""Every registered query against its SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as registry
import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_sql_has_a_query_for_each_entry():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    text = {name for name in registry.queries() if re.match(r"op\d+_|pipeline$", name)}
    assert set(registry.queries()) - set(registry.oracle_sql()) - text == set()


@pytest.mark.parametrize("name", registry.queries())
def test_query_matches_sql(spark, con, name):
    ok, message = check.compare(spark, con, name, SF)
    assert ok, message


def test_entry(spark):
    assert registry.entry(spark).limit(1).count() == 1
