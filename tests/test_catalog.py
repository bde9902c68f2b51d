"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from compare import same
from memlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        same(df, SF, catalog.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.SQL) <= set(__spark_entry__.queries())
