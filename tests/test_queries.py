"""Every query of the library's own operators beside its SQL."""

import pytest

from tests.compare import assert_same, duck
from tests.conftest import DATA
from tideline.plans import catalog

CON = duck(DATA)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, DATA)
    if name in catalog.oracles():
        assert_same(df, CON, catalog.oracles()[name])
    else:
        assert df.limit(5).collect() is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
