"""Every core query against its SQL, over the smallest tables."""

from __future__ import annotations

import pytest

from tests.compare import DATA, rows_of, sql_rows
from textlake.plans import registry

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert rows_of(registry.queries()[name](spark, SMALL)) == sql_rows(registry.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
