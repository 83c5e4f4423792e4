import sys

import pytest

sys.path.insert(0, __file__.rpartition("/")[0])
from oracle import same  # noqa: E402

from inkgraph.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], FOLDER)


def test_every_query_has_a_name_of_its_own():
    assert set(registry.oracle_sql()) <= set(registry.queries())
