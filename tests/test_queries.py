"""Every registered query against its SQL twin, or against a non-empty result where SQL cannot say it."""

import pytest

from allotment.catalog import ORACLES, QUERIES
from check import compare
from conftest import FOLDER


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, ORACLES[name], con) == "ok"
    else:
        assert df.count() > 0
