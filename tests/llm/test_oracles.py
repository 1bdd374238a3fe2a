"""Operators that SQL can express agree with it, and every operator is registered."""

import re

import pytest

from tessera.llm import queries as Q
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert not differences(Q.queries()[name](spark, SF), connect(SF), Q.oracle_sql()[name])


def test_all_are_registered():
    names = list(Q.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names[:-1]] == list(range(1, 14)) and names[-1] == "pipeline"
