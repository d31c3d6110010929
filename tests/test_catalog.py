import pytest

from folioflow import catalog
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def test_csv_delimiters():
    from folioflow.sources.csv_tables import parse

    assert parse("a;b\n1;\"x;y\"") == [["a", "b"], ["1", "x;y"]]
    assert parse("﻿a,b\n1") == [["a", "b"], ["1", ""]]
    assert parse(None) == []
