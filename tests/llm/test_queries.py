"""Every named query of the subpackage against its SQL; the others must give a row for each of their table."""

import pytest

from fathomline.llm.queries import C
from tests.oracle import difference


@pytest.mark.parametrize("name", sorted(C.queries))
def test_query(name, spark, folder, oracle):
    df = C.queries[name](spark, folder)
    if name in C.sql:
        assert difference(df, oracle, C.sql[name]) is None
    else:
        rows = df.collect()
        source = "pages" if "page_id" in df.columns else "documents"
        wanted = "count(DISTINCT conv_id) FROM conversations" if "conv_id" in df.columns else f"count(*) FROM {source}"
        expected = oracle.sql(f"SELECT {wanted}").fetchall()[0][0] + (name == "op8_chat_formatting")
        assert len(rows) == expected
