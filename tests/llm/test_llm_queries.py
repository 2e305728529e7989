import os

import pytest

from lodestat.llm import queries as Q
from tests.oracle import difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    if name in Q.SQL:
        mine, theirs = difference(spark, FOLDER, Q.QUERIES[name], Q.SQL[name])
        assert not mine and not theirs
    else:
        assert Q.QUERIES[name](spark, FOLDER).count() > 0
