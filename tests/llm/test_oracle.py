"""The registered queries against their SQL."""

import pytest
from check_oracle import compare, connect

from cilode.llm.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE)
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name) is None
