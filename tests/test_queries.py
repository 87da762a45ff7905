"""Every registered query of the dictionary engine against its SQL."""

import pytest

from glossmill.plans import catalog, dictionaries  # noqa: F401  both register queries
from glossmill.plans.registered import ORACLES, QUERIES
from tests.conftest import SMALL, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
