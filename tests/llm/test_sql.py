import sys

import pytest

sys.path.insert(0, __file__.rpartition("/")[0])
from oracle import same  # noqa: E402

from inkgraph.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], FOLDER) > 0
