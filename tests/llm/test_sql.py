"""Queries against their SQL."""

import pytest

from listwright.llm.queries import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), ORACLES[name], sf) is None
