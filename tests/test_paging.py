"""Pages by their place."""

import random

import pytest
from pyspark.sql import functions as F

from stowage.operators.paging import PagedTable


@pytest.fixture(scope="module")
def paged(spark, tmp_path_factory):
    ids = list(range(60_000))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i // 7, i % 7, f"v{i}") for i in ids], "a int, b int, `odd name` string").repartition(5)
    return PagedTable.build(df, ["a", "b"], str(tmp_path_factory.mktemp("paged") / "t"), range_rows=2500)


@pytest.mark.parametrize("number,size", [(0, 10), (3, 1000), (10_000, 5), (24, 2500), (7, 4001), (59_999, 1)])
def test_pages_are_those_of_the_order(paged, number, size):
    rows = paged.page(number, size).collect()
    expected = range(number * size, min((number + 1) * size, 60_000))
    assert [r["odd name"] for r in rows] == [f"v{i}" for i in expected]


def test_a_deep_page_reads_one_range(paged):
    page = paged.page(10_000, 5)
    assert paged.index().count() == 24
    assert len(page.inputFiles()) == 1 and "_part=20" in page.inputFiles()[0]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_place,50000)" in plan and "LessThan(_place,50005)" in plan


def test_pages_behind_the_end(paged):
    assert paged.page(12_000, 5).collect() == [] and paged.page(12_000, 5).columns == ["a", "b", "odd name"]
    assert paged.pages(7001) == 9
    assert sum(p.count() for p in paged.each(25_000)) == 60_000


def test_ties_nulls_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(None,), (1,), (1,), (1,), (2,)], "a int")
    paged = PagedTable.build(df, ["a"], str(tmp_path / "t"), range_rows=2)
    assert [r.a for n in range(3) for r in paged.page(n, 2).collect()] == [None, 1, 1, 1, 2]
    empty = PagedTable.build(df.limit(0), ["a"], str(tmp_path / "e"))
    assert empty.page(0, 5).collect() == [] and empty.pages(5) == 0
    with pytest.raises(ValueError, match="_place"):
        PagedTable.build(df.withColumn("_place", F.lit(1)), ["a"], str(tmp_path / "x"))
