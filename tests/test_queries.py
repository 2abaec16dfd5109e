"""Every query with SQL agrees with it on the smallest tables; every other query runs."""

from pathlib import Path

import pytest

from kinloom import queries
from oracle import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() >= 0
