from __future__ import annotations

import pytest
from oracle import rows_of, run_sql

from scenewright.llm import registry


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name, scale):
    sf = f"/root/testdata/sf{scale}"
    got, want = registry.QUERIES[name](spark, sf).toPandas(), run_sql(registry.SQL[name], sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
