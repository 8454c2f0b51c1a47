"""Every core query against its SQL on the smallest tables."""

import pytest

from tests import oracle
from wardsieve.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = oracle.same(catalog.queries()[name](spark, oracle.SMALL), SQL[name], duck)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert catalog.queries()[name](spark, oracle.SMALL).count() > 0


def test_released_tables_are_gone(spark):
    import os

    from wardsieve import runtime

    kept = runtime.persist_table(spark.range(3), "kept")
    assert os.path.exists(kept.inputFiles()[0].removeprefix("file://"))
    runtime.release(spark)
    assert not os.path.exists(f"{runtime.shared_dir(spark)}/wardsieve/{spark.sparkContext.applicationId}/kept")
    assert runtime.persist_table(spark.range(3), "again").count() == 3
