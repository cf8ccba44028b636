"""Every registered query gives what DuckDB gives on the same tables."""

import pytest

from checks.answers import ANSWERS
from checks.compare import compare
from checks.queries import QUERIES


def test_every_query_has_an_answer():
    assert set(QUERIES) == set(ANSWERS)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, folder, key):
    same, message, _ = compare(spark, duck, folder, key, QUERIES[key], ANSWERS[key])
    assert same, message
