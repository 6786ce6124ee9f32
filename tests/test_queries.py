"""Every named query against its SQL; the few without one must give rows."""

import pytest

from fathomline.catalog import everything
from tests.oracle import difference

CATALOG = everything()


@pytest.mark.parametrize("name", sorted(CATALOG.queries))
def test_query(name, spark, folder, oracle):
    df = CATALOG.queries[name](spark, folder)
    if name in CATALOG.sql:
        assert difference(df, oracle, CATALOG.sql[name]) is None
    else:
        assert df.columns
        df.collect()
