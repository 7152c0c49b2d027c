import pytest

import __spark_entry__ as entry
from mirrorplan import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, entry, name, "/root/testdata/sf0.01") > 0
