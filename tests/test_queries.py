"""Every query of the knowledge-base catalogue against its SQL, or for its rows where it has none."""

from __future__ import annotations

import pytest
from compare import SF, rows_of_duck, rows_of_spark

from marlstone.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    if name in ORACLES:
        assert rows_of_spark(found) == rows_of_duck(duck, ORACLES[name])
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
