"""Parsers and rules on their cases."""

import pytest

from tests import cases
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_case(spark, sf, name):
    assert compare(cases.QUERIES[name](spark, sf), cases.ORACLES[name], sf) is None
