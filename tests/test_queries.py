"""Every query of the library against its SQL twin."""

from __future__ import annotations

import pytest
from compare import differences

from heronry.plans.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, FOLDER, QUERIES[name], ORACLE_SQL[name]) == ""
