from __future__ import annotations

import pytest
from compare import differences

from segue.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir):
    assert differences(QUERIES[name], ORACLES[name], spark, sf_dir) == ""
