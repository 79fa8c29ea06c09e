"""Every registered query of the engine against its SQL; those without SQL must give rows."""

from __future__ import annotations

import pytest

from glossa.registry import ORACLES, QUERIES
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        assert differences(df, ORACLES[name], duck) == ""
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
