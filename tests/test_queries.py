"""Every query with SQL against that SQL."""

import pytest

from quillspark.plans import registry

from oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], SF) > 0
