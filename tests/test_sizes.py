"""What grows with the tables: tasks, and the forms of joins."""

import pytest

import __spark_entry__
from folioflow.operators import tables

ROWS = 2_000


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """A table of customers in one small file, as the driver's tables are."""
    folder = tmp_path_factory.mktemp("sizes")
    made = spark.range(1, ROWS + 1).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "id % 25 AS c_nationkey", "concat('S', id % 5) AS c_mktsegment")
    made.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["mail_elements", "pdf_lines", "word_formulas", "chart_parts", "legacy_elements", "recognised_pages", "html_cells", "model_elements", "office_elements", "vector_elements"])
def test_files_are_made_and_read_in_many_tasks(spark, one_file, name):
    found = __spark_entry__.queries()[name](spark, one_file).rdd.glom().map(len).collect()
    assert sum(n > 0 for n in found) >= 8


def test_tasks_grow_with_rows(spark):
    assert [tables.tasks(spark.range(n)) for n in (0, 1, 60_000, 1_000_000, 9_000_000)] == [1, 1, 3, 8, 36]


@pytest.mark.parametrize("name", ["budgeted_chunks", "tree_references", "tree_round_trip", "safe_images", "table_runs", "grid_places", "cell_grids"])
def test_lines_are_spread_by_their_number(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
