"""Every flight query beside its SQL, over the same tables."""

from __future__ import annotations

import pytest

from tests.conftest import rows_of
from turnflow import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_equals_sql(spark, duck, sf_dir, name):
    ours = Q.QUERIES[name](spark, sf_dir).toPandas()
    theirs = duck.execute(Q.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.ORACLES)
